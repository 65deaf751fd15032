"""Queries for splits, threshold search, evaluation and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.operators import detectors as D
from leakscope.operators import metrics as M
from leakscope.operators import report as R
from leakscope.operators import shape
from leakscope.operators import thresholds as TH
from leakscope.plans import sql as S
from leakscope.plans import tuning
from leakscope.plans.registry import query
from leakscope.session import settle
from leakscope.sources import tables as T

FEATURES = ("n_words", "distinct_share", "chars_per_word", "n_chars")
# A fixed rule per feature for the queries that do not search one.
THETAS = {
    "n_words": 150.0, "distinct_share": 0.55, "chars_per_word": 6.0,
    "line_repeat": 0.01, "digit_share": 0.001, "n_chars": 1000.0,
}
VOTERS = tuple(THETAS)

LARGE = S.LARGE
FEAT = "feat AS (" + " UNION ALL ".join(
    f"SELECT {i} AS grid_pos, ID, y, {c}::DOUBLE AS x FROM large" for i, c in enumerate(FEATURES)
) + ")"
VOTES = "votes AS (SELECT ID, CATEGORY, y, " + ", ".join(
    f"(CASE WHEN {c} > {t!r}::DOUBLE THEN 1 ELSE 0 END) AS v_{c}" for c, t in THETAS.items()
) + " FROM large)"


def features_long(spark: SparkSession, sf: str) -> DataFrame:
    rows = ", ".join(
        f"named_struct('grid_pos', {i}, 'feature', cast({c} as double))"
        for i, c in enumerate(FEATURES)
    )
    return T.labelled_documents(spark, sf).selectExpr(
        "ID", "CATEGORY", "LABEL_BINARY", f"inline(array({rows}))"
    )


def votes(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.labelled_documents(spark, sf)
    cols = [F.expr(f"cast({c} > {t!r}D as int) as v_{c}") for c, t in THETAS.items()]
    return docs.select("ID", "CATEGORY", "LABEL_BINARY", *cols)


@query(
    "category_filter",
    S.with_(LARGE) + "SELECT ID, CATEGORY, y AS LABEL_BINARY FROM large WHERE CATEGORY = 'fr'",
)
def category_filter(spark: SparkSession, sf: str) -> DataFrame:
    return shape.filter_category(T.labelled_documents(spark, sf), "fr").select(
        "ID", "CATEGORY", "LABEL_BINARY"
    )


@query(
    "stratified_split",
    S.with_(
        LARGE,
        "cnt AS (SELECT CATEGORY, y, count(*) AS n FROM large GROUP BY CATEGORY, y)",
        """sized AS (SELECT *, sum(n) OVER () AS n_all FROM cnt),
want AS (SELECT *, ceil(0.3::DOUBLE * n_all)::BIGINT AS t FROM sized),
share AS (SELECT *, (t * n) // n_all AS s, (t * n) % n_all AS r FROM want),
turn AS (SELECT *, row_number() OVER (ORDER BY r DESC, CATEGORY, y) AS k, t - sum(s) OVER () AS rest FROM share),
alloc AS (SELECT CATEGORY, y, s + CASE WHEN k <= rest THEN 1 ELSE 0 END AS n_test FROM turn)""",
    )
    + """SELECT ID, CATEGORY, y AS LABEL_BINARY, rk <= n_test AS is_test FROM (
  SELECT *, row_number() OVER (PARTITION BY CATEGORY, y ORDER BY md5('42|' || ID), ID) AS rk FROM large) JOIN alloc USING (CATEGORY, y)""",
)
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    items = T.labelled_documents(spark, sf).select("ID", "CATEGORY", "LABEL_BINARY")
    return TH.stratified_split(items, 0.3, 42)


@query(
    "stratified_folds",
    S.with_(LARGE)
    + """SELECT ID, y AS LABEL_BINARY,
  ((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || ID), ID) - 1) % 5)::INTEGER AS fold FROM large""",
)
def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    items = T.labelled_documents(spark, sf).select("ID", "LABEL_BINARY")
    return TH.stratified_folds(items, 5, 42)


@query(
    "candidate_thresholds",
    S.with_(LARGE, FEAT, S.cv())
    + "SELECT grid_pos, round(t, 9) AS t FROM cand WHERE f = -1",
)
def candidate_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return TH.candidate_thresholds(
        features_long(spark, sf), "feature", "LABEL_BINARY", ["grid_pos"]
    ).select("grid_pos", F.round("t", 9).alias("t"))


@query(
    "best_threshold",
    S.with_(LARGE, FEAT, S.cv())
    + "SELECT grid_pos, round(t, 9) AS t, round(train_acc, 9) AS acc FROM best WHERE f = -1",
)
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return TH.best_threshold(
        features_long(spark, sf), "feature", "LABEL_BINARY", ["grid_pos"]
    ).select("grid_pos", F.round("t", 9).alias("t"), F.round("acc", 9).alias("acc"))


@query(
    "threshold_accuracy",
    S.with_(LARGE)
    + """SELECT CATEGORY, round(avg(CASE WHEN (n_words >= 150) = (y = 1) THEN 1::DOUBLE ELSE 0 END), 9) AS acc FROM large GROUP BY CATEGORY""",
)
def threshold_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.labelled_documents(spark, sf)
    return TH.threshold_accuracy(docs, "n_words", "LABEL_BINARY", 150.0, ["CATEGORY"]).select(
        "CATEGORY", F.round("acc", 9).alias("acc")
    )


@query(
    "best_threshold_lineitem",
    """WITH b AS (SELECT l_extendedprice AS x, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS n
  FROM lineitem GROUP BY 1),
c AS (SELECT x, p, n, lag(x) OVER w AS px, lag(p) OVER w AS pp,
  sum(p) OVER w - p AS bp, sum(n) OVER w - n AS bn, sum(p) OVER () AS tp, sum(p + n) OVER () AS tn
  FROM b WINDOW w AS (ORDER BY x)),
d AS (SELECT (px + x) / 2 AS t, bn + tp - bp AS h, tn FROM c WHERE px IS NOT NULL AND (pp > 0) <> (n = 0)
  UNION ALL SELECT x, bn + tp - bp, tn FROM c WHERE p > 0 AND n > 0)
SELECT round(t, 9) AS t, round(h::DOUBLE / tn, 9) AS acc FROM d ORDER BY h DESC, t LIMIT 1""",
)
def best_threshold_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.table(spark, sf, "lineitem").select(
        "l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("y")
    )
    return TH.best_threshold(rows, "l_extendedprice", "y").select(
        F.round("t", 9).alias("t"), F.round("acc", 9).alias("acc")
    )


@query("cv_threshold", S.with_(LARGE, FEAT, S.cv()) + S.CV_ROWS)
def cv_threshold(spark: SparkSession, sf: str) -> DataFrame:
    features = settle(features_long(spark, sf))
    folds = TH.stratified_folds(features.select("ID", "LABEL_BINARY").distinct(), 5, 42)
    keyed = features.join(folds.select("ID", "fold"), "ID")
    return TH.cv_threshold(keyed, "feature", "LABEL_BINARY", 5, ["grid_pos"]).select(
        "grid_pos", "fold", F.round("t", 9).alias("t"), F.round("train_acc", 9).alias("train_acc"),
        F.round("test_acc", 9).alias("test_acc"),
    )


@query("tune_documents", S.with_(LARGE, FEAT, S.cv(), S.TUNED))
def tune_documents(spark: SparkSession, sf: str) -> DataFrame:
    return tuning.tune(features_long(spark, sf)).select(
        "grid_pos", "global_threshold", "median_threshold", "mean_cvacc_train",
        "mean_cvacc_test", "is_best",
    )


@query(
    "best_pair_2d",
    S.with_(LARGE, "feat2 AS (SELECT 0 AS grid_pos, ID, y, n_words::DOUBLE AS a, distinct_share AS b FROM large)", S.cv_pair())
    + "SELECT round(ta, 9) AS ta, round(tb, 9) AS tb, round(train_acc, 9) AS acc FROM best WHERE f = -1",
)
def best_pair_2d(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.labelled_documents(spark, sf)
    return TH.best_pair(docs, "n_words", "distinct_share", "LABEL_BINARY").select(
        F.round("ta", 9).alias("ta"), F.round("tb", 9).alias("tb"), F.round("acc", 9).alias("acc")
    )


@query(
    "predict_pair",
    S.with_(LARGE)
    + """SELECT ID, (CASE WHEN n_words < 150 OR distinct_share > 0.55::DOUBLE THEN 1 ELSE 0 END)::INTEGER AS PREDICTION_BINARY,
  '(150.0, 0.55)' AS THRESHOLD FROM large""",
)
def predict_pair(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.labelled_documents(spark, sf)
    return M.predict(docs, ("n_words", "distinct_share"), (150.0, 0.55), "curve").select(
        "ID", "PREDICTION_BINARY", "THRESHOLD"
    )


@query(
    "predict_extend",
    S.with_(LARGE)
    + """SELECT ID, p AS PREDICTION_BINARY, (p = y)::INTEGER AS CORRECT_PRED, '0.55' AS THRESHOLD, p AS minK
  FROM (SELECT ID, y, (CASE WHEN distinct_share > 0.55::DOUBLE THEN 1 ELSE 0 END)::INTEGER AS p FROM large)""",
)
def predict_extend(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.labelled_documents(spark, sf)
    return M.predict(docs, "distinct_share", 0.55, "minK").select(
        "ID", "PREDICTION_BINARY", "CORRECT_PRED", "THRESHOLD", "minK"
    )


_COUNTS = """cm AS (SELECT CATEGORY, count(*) FILTER (y = 0 AND v_n_words = 0) AS tn, count(*) FILTER (y = 0 AND v_n_words = 1) AS fp,
  count(*) FILTER (y = 1 AND v_n_words = 0) AS fn, count(*) FILTER (y = 1 AND v_n_words = 1) AS tp FROM votes GROUP BY CATEGORY)"""


@query(
    "confusion_metrics",
    S.with_(LARGE, VOTES, _COUNTS)
    + """SELECT CATEGORY, tn, fp, fn, tp, round((tn + tp)::DOUBLE / (tn + fp + fn + tp), 9) AS accuracy,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1_score FROM cm""",
)
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = M.classification_metrics(votes(spark, sf), "v_n_words", by=["CATEGORY"])
    return out.select(
        "CATEGORY", "tn", "fp", "fn", "tp",
        *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1_score")],
    )


@query(
    "mcnemar",
    S.with_(LARGE, VOTES, _COUNTS)
    + f"SELECT CATEGORY, tn AS mcnemar_b, fn AS mcnemar_c, round({S.mcnemar('tn', 'fn')}, 9) AS mcnemar_p_value FROM cm",
)
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    counts = M.classification_metrics(votes(spark, sf), "v_n_words", by=["CATEGORY"])
    return M.mcnemar(counts).select(
        "CATEGORY", "mcnemar_b", "mcnemar_c", F.round("mcnemar_p_value", 9).alias("mcnemar_p_value")
    )


def _right(spark: SparkSession, sf: str) -> DataFrame:
    return votes(spark, sf).groupBy("CATEGORY").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("v_n_words") == F.col("LABEL_BINARY")).alias("right"),
    )


def _resampled(groups: str, key: str) -> str:
    """From ``groups`` (grp, n, c): bounds of 1,000 binomial quantiles at md5 shares."""
    return f"""grp AS ({groups}),
term AS (SELECT grp, k, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + CASE WHEN k > 0 THEN k * ln(c / n::DOUBLE) ELSE 0 END
    + CASE WHEN k < n THEN (n - k) * ln(1 - c / n::DOUBLE) ELSE 0 END) AS w
  FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM grp) WHERE c > 0 AND c < n),
upto AS (SELECT grp, k, sum(w) OVER (PARTITION BY grp ORDER BY k) AS p FROM term),
share AS (SELECT grp, n, c, b, (('0x' || substr(md5('42|' || {key}), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656 AS u
  FROM (SELECT *, unnest(range(1, 1001)) AS b FROM grp)),
drawn AS (SELECT s.grp, s.b, CASE WHEN any_value(c) IN (0, any_value(n)) THEN any_value(c) ELSE count(k) END / any_value(n)::DOUBLE AS acc
  FROM share s LEFT JOIN upto t ON t.grp = s.grp AND t.p < s.u GROUP BY s.grp, s.b),
bound AS (SELECT grp, quantile_cont(acc, 0.025::DOUBLE) AS acc_lower, quantile_cont(acc, 0.975::DOUBLE) AS acc_upper FROM drawn GROUP BY grp)"""


@query(
    "bootstrap_ci",
    S.with_(
        LARGE, VOTES,
        "rt AS (SELECT CATEGORY, count(*) AS n, count(*) FILTER (v_n_words = y) AS c FROM votes GROUP BY CATEGORY)",
        """dr AS (SELECT CATEGORY, n, c, b, unnest(range(1, n + 1)) AS j FROM (SELECT *, unnest(range(1, 1001)) AS b FROM rt)),
ac AS (SELECT CATEGORY, b, avg(CASE WHEN ('0x' || substr(md5('42|' || b || '|' || j), 1, 12))::BIGINT % n < c THEN 1::DOUBLE ELSE 0 END) AS acc
  FROM dr GROUP BY CATEGORY, b)""",
    )
    + """SELECT CATEGORY, round(quantile_cont(acc, 0.025::DOUBLE), 9) AS acc_lower, round(quantile_cont(acc, 0.975::DOUBLE), 9) AS acc_upper
  FROM ac GROUP BY CATEGORY""",
)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return M.resampled_ci(_right(spark, sf), 1000, 42, ["CATEGORY"]).select(
        "CATEGORY", F.round("acc_lower", 9).alias("acc_lower"),
        F.round("acc_upper", 9).alias("acc_upper"),
    )


@query(
    "evaluate",
    S.with_(
        LARGE,
        """cm AS (SELECT count(*) FILTER (y = 0 AND NOT p) AS tn, count(*) FILTER (y = 0 AND p) AS fp, count(*) FILTER (y = 1 AND NOT p) AS fn,
  count(*) FILTER (y = 1 AND p) AS tp FROM (SELECT y, n_words > 150 AS p FROM large))""",
        _resampled("SELECT 'all' AS grp, tn + fp + fn + tp AS n, tn + tp AS c FROM cm", "b"),
    )
    + f"""SELECT 'corpus' AS model_id, 'documents' AS data_name, 'n_words' AS method_name, '150.0' AS theta,
  round((tn + tp)::DOUBLE / (tn + fp + fn + tp), 9) AS accuracy, round(acc_lower, 9) AS acc_lower, round(acc_upper, 9) AS acc_upper,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1_score, tn, fp, fn, tp,
  tn AS mcnemar_b, fn AS mcnemar_c, round({S.mcnemar('tn', 'fn')}, 9) AS mcnemar_p_value, 1000 AS n_bootstrap, 42 AS seed
  FROM cm, bound""",
)
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """The test-log record without its run time, nested values as columns."""
    docs = T.labelled_documents(spark, sf)
    log = tuning.evaluate(docs, "n_words", 150.0, "corpus", "documents", "n_words")
    rounded = ("accuracy", "precision", "recall", "f1_score", "mcnemar_p_value")
    cells = F.col("metrics.confusion_matrix")
    return log.select(
        "model_id", "data_name", "method_name", "parameter.theta", "n_bootstrap", "seed",
        "metrics.mcnemar_b", "metrics.mcnemar_c",
        *[F.round(f"metrics.{c}", 9).alias(c) for c in rounded],
        *[F.round(F.col("metrics.accuracy_95CI")[i], 9).alias(c) for i, c in enumerate(("acc_lower", "acc_upper"))],
        *[cells[i][j].alias(c) for i, j, c in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))],
    )


_LOGS = """m AS (SELECT 'n_words' AS grp, '150.0' AS theta, y, n_words > 150 AS p FROM large
  UNION ALL SELECT 'n_chars', '1000.0', y, n_chars > 1000 FROM large),
cm AS (SELECT grp, theta, count(*) FILTER (y = 0 AND NOT p) AS tn, count(*) FILTER (y = 0 AND p) AS fp, count(*) FILTER (y = 1 AND NOT p) AS fn,
  count(*) FILTER (y = 1 AND p) AS tp FROM m GROUP BY grp, theta)"""


@query(
    "flatten_test_logs",
    S.with_(
        LARGE, _LOGS.replace("grp", "method"),
        _resampled("SELECT method AS grp, tn + fp + fn + tp AS n, tn + tp AS c FROM cm", "b"),
    )
    + f"""SELECT 'org/corpus' AS model_id, 'documents' AS data_name, method AS method_name,
  method || '_parameter1=None_parameter2=None_theta=' || theta AS method_name_with_param, theta AS param_theta,
  round((tn + tp)::DOUBLE / (tn + fp + fn + tp), 9) AS accuracy, round(acc_lower, 9) AS accuracy_95CI_lower,
  round(acc_upper, 9) AS accuracy_95CI_upper, round(coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1_score,
  tn AS mcnemar_b, fn AS mcnemar_c, round({S.mcnemar('tn', 'fn')}, 9) AS mcnemar_p_value, tp, 1000 AS n_bootstrap
  FROM cm JOIN bound ON bound.grp = cm.method""",
)
def flatten_test_logs(spark: SparkSession, sf: str) -> DataFrame:
    docs = settle(T.labelled_documents(spark, sf))
    logs = [
        tuning.evaluate(docs, c, THETAS[c], "org/corpus", "documents", c) for c in ("n_words", "n_chars")
    ]
    log = logs[0].unionByName(logs[1])
    names = ("parameter1", "parameter2", "theta")
    pairs = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"parameter.{n}"))])
    flat = R.flatten_test_logs(log.withColumn("parameter", pairs))
    rounded = ("accuracy", "accuracy_95CI_lower", "accuracy_95CI_upper", "f1_score", "mcnemar_p_value")
    return flat.select(
        "model_id", "data_name", "method_name", "method_name_with_param", "param_theta", "mcnemar_b",
        "mcnemar_c", F.col("confusion_matrix")[1][1].alias("tp"), "n_bootstrap",
        *[F.round(c, 9).alias(c) for c in rounded],
    )


LOG_KS = (5, 10, 20, 40)  # one per feature; the last is not in the summary's list


def train_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Tuning records per language: every feature in turn, and one pair of features."""
    by_language = features_long(spark, sf).withColumn("model_id", F.concat(F.lit("org/"), "CATEGORY"))
    single = tuning.tune(by_language, by=("model_id", "grid_pos"))
    pair = tuning.tune_pair(
        T.labelled_documents(spark, sf).select(
            "ID", "LABEL_BINARY", F.concat(F.lit("org/"), "CATEGORY").alias("model_id"),
            F.lit(len(FEATURES)).alias("grid_pos"), "n_words", "distinct_share",
        ),
        "n_words", "distinct_share", by=("model_id", "grid_pos"),
    )
    k = F.array(*[F.lit(k) for k in LOG_KS])[F.col("grid_pos")]
    entries = tuning.log_entries(single, "feature", F.create_map(F.lit("k"), k.cast("string")))
    both = tuning.log_entries(pair, "pair", F.create_map(F.lit("fit"), F.lit("pair")), fit="pair")
    return tuning.train_log(entries.unionByName(both), "documents", "feature", {"k": str(list(LOG_KS))})


_TRAIN = (
    LARGE,
    "feat AS (" + " UNION ALL ".join(
        f"SELECT CATEGORY || '|{i}' AS grid_pos, ID, y, {c}::DOUBLE AS x FROM large" for i, c in enumerate(FEATURES)
    ) + ")",
    S.cv(),
    """flat AS (SELECT 'org/' || split_part(grid_pos, '|', 1) AS model_id, split_part(grid_pos, '|', 2)::INTEGER AS grid_pos,
  avg(round(test_acc, 6)) FILTER (f >= 0) AS mean_val_acc, stddev_pop(round(test_acc, 6)) FILTER (f >= 0) AS std_val_acc,
  avg(round(train_acc, 6)) FILTER (f >= 0) AS mean_train_acc, stddev_pop(round(train_acc, 6)) FILTER (f >= 0) AS std_train_acc,
  avg(round(t, 6)) FILTER (f >= 0) AS mean_threshold, round(max(t) FILTER (f = -1), 6) AS global_threshold FROM cvr GROUP BY 1, 2)""",
    f"named AS (SELECT *, [{', '.join(map(str, LOG_KS))}][grid_pos + 1] AS k FROM flat)",
)
_TRAIN_PAIR = (
    LARGE,
    "feat2 AS (SELECT CATEGORY AS grid_pos, ID, y, n_words::DOUBLE AS a, distinct_share AS b FROM large)",
    S.cv_pair(),
    """pairs AS (SELECT 'org/' || grid_pos AS model_id, avg(round(test_acc, 6)) FILTER (f >= 0) AS mean_val_acc,
  stddev_pop(round(test_acc, 6)) FILTER (f >= 0) AS std_val_acc, avg(round(train_acc, 6)) FILTER (f >= 0) AS mean_train_acc,
  stddev_pop(round(train_acc, 6)) FILTER (f >= 0) AS std_train_acc, avg(round(ta, 6) + round(tb, 6)) FILTER (f >= 0) / 2 AS mean_threshold,
  round(max(ta) FILTER (f = -1), 6) AS first, round(max(tb) FILTER (f = -1), 6) AS second FROM cvr GROUP BY 1)""",
)
_FLAT = ("mean_val_acc", "std_val_acc", "mean_train_acc", "std_train_acc", "mean_threshold")
_FLAT_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _FLAT)


@query(
    "flatten_train_logs",
    "SELECT * FROM (" + S.with_(*_TRAIN)
    + f"""SELECT model_id, grid_pos, 'feature' AS method_name, 'feature_k=' || k AS method_name_with_param, {_FLAT_SQL},
  global_threshold AS threshold_1, NULL AS threshold_2, k::VARCHAR AS param_k FROM named) UNION ALL SELECT * FROM ("""
    + S.with_(*_TRAIN_PAIR)
    + f"""SELECT model_id, {len(FEATURES)} AS grid_pos, 'pair' AS method_name, 'pair_fit=pair' AS method_name_with_param, {_FLAT_SQL},
  first AS threshold_1, second AS threshold_2, NULL AS param_k FROM pairs)""",
)
def flatten_train_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Tuning results written as records of one type and flattened again."""
    flat = R.flatten_train_logs(train_logs(spark, sf), params=("k",))
    theta = F.col("global_threshold")
    return flat.select(
        "model_id", "grid_pos", "method_name", "method_name_with_param", "param_k",
        F.try_element_at(theta, F.lit(1)).alias("threshold_1"),
        F.try_element_at(theta, F.lit(2)).alias("threshold_2"),
        *[F.round(c, 6).alias(c) for c in _FLAT],
    )


LANGUAGES = ("de", "en", "es", "fr")


@query(
    "summary_table",
    S.with_(
        *_TRAIN,
        """cell AS (SELECT 'feature_k=' || k AS method, split_part(model_id, '/', 2) AS lang, round_even(mean_val_acc, 2) AS m,
  round_even(std_val_acc, 3) AS s FROM named WHERE k IN (5, 10, 20, 30))""",
    )
    + "SELECT method AS method_name_with_param, "
    + ", ".join(f"max(m || ' ± ' || s) FILTER (lang = '{x}') AS {x}" for x in LANGUAGES)
    + """, round_even(avg(m), 4) || ' ± ' || coalesce(round_even(stddev_samp(m), 4)::VARCHAR, 'nan') AS result FROM cell GROUP BY method
UNION ALL SELECT 'baseline', """
    + ", ".join("'0.5 ± 0.0'" for _ in range(len(LANGUAGES) + 1)),
)
def summary_table(spark: SparkSession, sf: str) -> DataFrame:
    single = R.flatten_train_logs(train_logs(spark, sf), params=("k", "alpha")).where("method_name = 'feature'")
    return R.summary_table(single, models=LANGUAGES)


@query(
    "run_detector",
    S.with_(LARGE)
    + """SELECT count(*) FILTER (y = 0 AND NOT p) AS tn, count(*) FILTER (y = 0 AND p) AS fp, count(*) FILTER (y = 1 AND NOT p) AS fn,
  count(*) FILTER (y = 1 AND p) AS tp, round(avg(CASE WHEN p = (y = 1) THEN 1::DOUBLE ELSE 0 END), 9) AS accuracy
  FROM (SELECT y, chars_per_word >= 6 AS p FROM large)""",
)
def run_detector(spark: SparkSession, sf: str) -> DataFrame:
    out = tuning.run_detector(
        T.labelled_documents(spark, sf), lambda d: D.clean_features(d, ["chars_per_word"]),
        "chars_per_word", 6.0, strict=False,
    )
    return out.select("tn", "fp", "fn", "tp", F.round("accuracy", 9).alias("accuracy"))


@query(
    "join_votes",
    S.with_(LARGE, VOTES)
    + "SELECT ID, y AS LABEL_BINARY, v_n_words, v_distinct_share, v_n_chars FROM votes",
)
def join_votes(spark: SparkSession, sf: str) -> DataFrame:
    table = votes(spark, sf)
    cols = ["v_n_words", "v_distinct_share", "v_n_chars"]
    joined = D.join_votes([table.select("ID", c) for c in cols], cols, ["ID"])
    return shape.with_labels(joined, table)


# Two models with rules of their own, frames that lack items, and votes that are null.
SCALES = {"mild": 1.0, "strict": 1.5}


@query(
    "ensemble_votes",
    S.with_(
        LARGE,
        "model AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {x!r}::DOUBLE)" for m, x in SCALES.items()) + ") t(model_id, scale))",
        f"""cast_votes AS (SELECT model_id, ID, CATEGORY, y, (n_words > {THETAS['n_words']!r}::DOUBLE * scale)::INTEGER AS v_n_words,
  CASE WHEN digit_share > 0 THEN (distinct_share > {THETAS['distinct_share']!r}::DOUBLE * scale)::INTEGER END AS v_distinct_share,
  (n_chars > {THETAS['n_chars']!r}::DOUBLE * scale)::INTEGER AS v_n_chars, (chars_per_word > {THETAS['chars_per_word']!r}::DOUBLE)::INTEGER AS v_chars_per_word
  FROM large, model WHERE NOT (model_id = 'strict' AND CATEGORY = 'fr'))""",
    )
    + """SELECT model_id, ID, y AS LABEL_BINARY, v_n_words, v_distinct_share, v_n_chars, v_chars_per_word,
  (CASE WHEN s = 2 THEN CASE WHEN substr(md5('42|' || ID), 1, 1) < '8' THEN 1 ELSE 0 END WHEN s > 2 THEN 1 ELSE 0 END)::INTEGER AS PREDICTION_BINARY
  FROM (SELECT *, v_n_words + coalesce(v_distinct_share, 0) + v_n_chars + v_chars_per_word AS s FROM cast_votes)""",
)
def ensemble_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Votes of four detectors for two models, joined on (model_id, ID), and their majority."""
    scales = F.explode(
        F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit(x).alias("scale")) for m, x in SCALES.items()])
    )
    docs = T.labelled_documents(spark, sf).withColumn("m", scales).select("*", "m.model_id", "m.scale")
    cols = ["v_n_words", "v_distinct_share", "v_n_chars", "v_chars_per_word"]
    rules = {c: F.expr(f"cast({c[2:]} > {THETAS[c[2:]]!r}D * scale as int)") for c in cols[:3]}
    rules["v_chars_per_word"] = F.expr(f"cast(chars_per_word > {THETAS['chars_per_word']!r}D as int)")
    rules["v_distinct_share"] = F.when(F.col("digit_share") > 0, rules["v_distinct_share"])
    frames = [docs.select("model_id", "ID", "CATEGORY", rules[c].alias(c)) for c in cols]
    frames[2] = frames[2].where("not (model_id = 'strict' and CATEGORY = 'fr')")
    voted = D.majority_vote(D.join_votes(frames, cols), cols)
    return shape.with_labels(voted, docs, ["model_id", "ID"])


@query(
    "majority_vote",
    S.with_(LARGE, VOTES)
    + f"""SELECT ID, (CASE WHEN 2 * s = {len(VOTERS)} THEN CASE WHEN substr(md5('42|' || ID), 1, 1) < '8' THEN 1 ELSE 0 END
  WHEN 2 * s > {len(VOTERS)} THEN 1 ELSE 0 END)::INTEGER AS PREDICTION_BINARY
  FROM (SELECT ID, {' + '.join('v_' + c for c in VOTERS)} AS s FROM votes)""",
)
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return D.majority_vote(votes(spark, sf), [f"v_{c}" for c in VOTERS]).select(
        "ID", "PREDICTION_BINARY"
    )


@query(
    "vote_corr",
    S.with_(LARGE, VOTES)
    + " UNION ALL ".join(
        f"SELECT '{a}' AS method_a, '{b}' AS method_b, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 2) AS corr FROM votes"
        for a in [f"v_{c}" for c in VOTERS]
        for b in [f"v_{c}" for c in VOTERS]
    ),
)
def vote_corr(spark: SparkSession, sf: str) -> DataFrame:
    return M.vote_corr(votes(spark, sf), [f"v_{c}" for c in VOTERS])


@query(
    "box_stats",
    S.with_(
        LARGE,
        """qs AS (SELECT CATEGORY, y, quantile_cont(n_words::DOUBLE, 0.25::DOUBLE) AS q1, quantile_cont(n_words::DOUBLE, 0.5::DOUBLE) AS med,
  quantile_cont(n_words::DOUBLE, 0.75::DOUBLE) AS q3 FROM large GROUP BY CATEGORY, y)""",
    )
    + """SELECT CATEGORY, y AS LABEL_BINARY, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS med, round(any_value(q3), 6) AS q3,
  min(n_words) FILTER (n_words BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::BIGINT AS whisker_low,
  max(n_words) FILTER (n_words BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))::BIGINT AS whisker_high
  FROM large JOIN qs USING (CATEGORY, y) GROUP BY CATEGORY, y""",
)
def box_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.labelled_documents(spark, sf).select("CATEGORY", "LABEL_BINARY", "n_words")
    return M.box_stats(docs, "n_words", ["CATEGORY", "LABEL_BINARY"]).select(
        "CATEGORY", "LABEL_BINARY",
        *[F.round(c, 6).alias(c) for c in ("q1", "med", "q3")],
        *[F.col(c).cast("bigint").alias(c) for c in ("whisker_low", "whisker_high")],
    )


@query(
    "sample_ids",
    "SELECT conv_id, turn, role FROM conversations WHERE conv_id IN "
    "(SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY md5('42|' || conv_id), conv_id LIMIT 50)",
)
def sample_ids(spark: SparkSession, sf: str) -> DataFrame:
    turns = T.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return shape.sample_ids(turns, 50, 42, "conv_id")


@query(
    "accuracy_by_param",
    S.with_(LARGE, FEAT)
    + """SELECT grid_pos, round(avg(CASE WHEN (x > 150) = (y = 1) THEN 1::DOUBLE ELSE 0 END), 9) AS accuracy, count(*) AS n FROM feat GROUP BY grid_pos""",
)
def accuracy_by_param(spark: SparkSession, sf: str) -> DataFrame:
    scored = M.predict(features_long(spark, sf), "feature", 150.0, "vote")
    return M.accuracy_by_param(scored, ["grid_pos"]).select(
        "grid_pos", F.round("accuracy", 9).alias("accuracy"), "n"
    )


@query(
    "with_grid",
    S.with_(LARGE)
    + """SELECT ID, k::DOUBLE AS k, (row_number() OVER (PARTITION BY ID ORDER BY k) - 1)::INTEGER AS grid_pos
  FROM large CROSS JOIN (SELECT unnest([5, 10, 20, 30]) AS k)""",
)
def with_grid(spark: SparkSession, sf: str) -> DataFrame:
    items = T.labelled_documents(spark, sf).select("ID")
    return D.with_grid(items, [{"k": float(k)} for k in (5, 10, 20, 30)])


@query(
    "param_filter",
    """SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS param_k FROM events
  WHERE (props::JSON ->> '$.k') IS NULL OR (props::JSON ->> '$.k')::INTEGER IN (5, 10, 20, 30)""",
)
def param_filter(spark: SparkSession, sf: str) -> DataFrame:
    events = T.table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("param_k")
    )
    return shape.filter_params(events)


@query(
    "method_label",
    """SELECT event_type || '_k=' || coalesce(props::JSON ->> '$.k', 'None') AS method_label, count(*) AS n,
  round(avg(value), 6) AS mean_value FROM events GROUP BY 1""",
)
def method_label(spark: SparkSession, sf: str) -> DataFrame:
    from leakscope.functions.text import method_label as label

    params = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    events = T.table(spark, sf, "events").withColumn(
        "method_label", label(F.col("event_type"), params)
    )
    return events.groupBy("method_label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value")
    )
