"""Queries for detector features and their tuning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import arrays as A
from leakscope.operators import corpus as C
from leakscope.operators import detectors as D
from leakscope.operators import metrics as M
from leakscope.plans import corpus_queries as Q
from leakscope.plans import sql as S
from leakscope.plans.registry import query
from leakscope.plans.tuning import tune, tune_pair
from leakscope.sources import tables as T

KS = (5, 10, 20, 30)
ALPHAS = (0.0, 0.1, 0.2, 0.3)
NS = (1, 2, 3)
LL_NS = (1, 2, 3, 5)
CDD_NS = (5, 10)


def _rounded(df: DataFrame, keys: list[str], digits: int = 9, value: str = "feature") -> DataFrame:
    return df.select(*keys, F.round(value, digits).alias(value))


def _tuned(features: DataFrame) -> DataFrame:
    return tune(features).select(
        "grid_pos", "global_threshold", "median_threshold", "mean_cvacc_train",
        "mean_cvacc_test", "is_best",
    )


def _with_label(spark: SparkSession, sf: str, features: DataFrame) -> DataFrame:
    return features.join(Q.labelled(spark, sf), "ID")


def _values(name: str, values: tuple) -> str:
    rows = ", ".join(f"({i}, {v}{'' if isinstance(v, int) else '::DOUBLE'})" for i, v in enumerate(values))
    return f"{name}(grid_pos, v) AS (VALUES {rows})"


# -- lowest-k% probability -------------------------------------------------------------------

MINK = (
    *Q.TOKENS,
    _values("ks", KS),
    """mk AS (SELECT ID, grid_pos, v AS k, trunc(len(probs) * (v / 100::DOUBLE))::INTEGER AS m, list_sort(probs) AS sp FROM td CROSS JOIN ks),
minkf AS (SELECT ID, grid_pos, k, CASE WHEN m > 0 THEN list_sum(sp[1:m]) / m END AS x FROM mk)""",
)


def mink_table(spark: SparkSession, sf: str) -> DataFrame:
    return D.mink_features(Q.token_data(spark, sf), KS)


@query(
    "mink_value",
    S.with_(*MINK) + "SELECT ID, round(x, 12) AS mink FROM minkf WHERE k = 20",
)
def mink_value(spark: SparkSession, sf: str) -> DataFrame:
    return Q.token_data(spark, sf).select(
        "ID", F.round(A.mink(F.col("token_probs"), F.lit(20.0)), 12).alias("mink")
    )


@query(
    "mink_features",
    S.with_(*MINK) + "SELECT ID, k::DOUBLE AS k, round(x, 12) AS feature FROM minkf",
)
def mink_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(mink_table(spark, sf), ["ID", "k"], 12)


@query(
    "tune_mink",
    S.with_(*MINK, S.LABELS, "feat AS (SELECT grid_pos, ID, y, coalesce(x, 0) AS x FROM minkf JOIN lab USING (ID))", S.cv(), S.TUNED),
)
def tune_mink(spark: SparkSession, sf: str) -> DataFrame:
    features = D.clean_features(mink_table(spark, sf), ["feature"])
    return _tuned(_with_label(spark, sf, features.select("ID", "grid_pos", "feature")))


# -- n-gram accuracy ----------------------------------------------------------------------------

NGRAM = (
    *Q.PREDICTED,
    _values("ns", NS),
    """ngf AS (SELECT ID, grid_pos, v AS n,
  avg(CASE WHEN target[1:v] = coalesce(greedy, [])[1:v] THEN 1::DOUBLE ELSE 0 END) AS x
  FROM at_start LEFT JOIN greedy USING (context) CROSS JOIN ns GROUP BY ID, grid_pos, v)""",
)


def ngram_table(spark: SparkSession, sf: str) -> DataFrame:
    predicted = Q.ngram_rows(spark, sf)
    gathered = C.ngram_generation(predicted, Q.NGRAM)
    cut = F.map_from_arrays(
        F.array(*[F.lit(n) for n in NS]),
        F.array(
            *[
                F.struct(
                    F.expr(f"transform(TARGET_NGRAMS, g -> slice(g, 1, {n}))").alias("TARGET_NGRAMS"),
                    F.expr(f"transform(PREDICTED_NGRAMS, g -> slice(g, 1, {n}))").alias(
                        "PREDICTED_NGRAMS"
                    ),
                    F.col("START_POINTS"),
                )
                for n in NS
            ]
        ),
    )
    return D.ngram_features(gathered.select("ID", cut.alias("NGRAM_GENERATION_DATA")), NS)


@query(
    "ngram_accuracy",
    S.with_(*NGRAM) + "SELECT ID, n, round(x, 9) AS feature FROM ngf",
)
def ngram_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ngram_table(spark, sf), ["ID", "n"])


@query(
    "tune_ngram_acc",
    S.with_(*NGRAM, S.LABELS, "feat AS (SELECT grid_pos, ID, y, x FROM ngf JOIN lab USING (ID))", S.cv(), S.TUNED),
)
def tune_ngram_acc(spark: SparkSession, sf: str) -> DataFrame:
    return _tuned(_with_label(spark, sf, ngram_table(spark, sf)))


# -- n-gram log-likelihood ------------------------------------------------------------------------

LOGLIKE = (
    *Q.TOKENS,
    _values("ns", LL_NS),
    f"""lp AS (SELECT ID, grid_pos, n, lls, unnest(pts) AS s FROM (
  SELECT ID, grid_pos, v AS n, lls, {S.even('len(lls)', 'v', 10, 5)} AS pts FROM td CROSS JOIN ns)),
lrow AS (SELECT ID, grid_pos, n, s, list_sum(lls[s + 1:s + n]) AS ll FROM lp),
llf AS (SELECT td.ID, ns.grid_pos, ns.v AS n, avg(ll) AS x FROM td CROSS JOIN ns LEFT JOIN lrow
  ON lrow.ID = td.ID AND lrow.grid_pos = ns.grid_pos GROUP BY td.ID, ns.grid_pos, ns.v)""",
)


def ll_table(spark: SparkSession, sf: str) -> DataFrame:
    return D.ngram_ll_features(Q.token_data(spark, sf), LL_NS, 10, 5)


@query(
    "ngram_loglike",
    S.with_(*LOGLIKE)
    + "SELECT ID, n, s::INTEGER AS start, round(ll, 6) AS ngram_loglike FROM lrow",
)
def ngram_loglike(spark: SparkSession, sf: str) -> DataFrame:
    return ll_table(spark, sf).select(
        "ID", "n", F.inline(F.arrays_zip("start_points", "ngram_loglikes"))
    ).select(
        "ID", "n", F.col("start_points").alias("start"),
        F.round("ngram_loglikes", 6).alias("ngram_loglike"),
    )


@query(
    "ngram_ll_features",
    S.with_(*LOGLIKE) + "SELECT ID, n, round(x, 6) AS feature FROM llf",
)
def ngram_ll_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ll_table(spark, sf), ["ID", "n"], 6)


@query(
    "tune_ngram_ll",
    S.with_(*LOGLIKE, S.LABELS, "feat AS (SELECT grid_pos, ID, y, x FROM llf JOIN lab USING (ID))", S.cv(), S.TUNED),
)
def tune_ngram_ll(spark: SparkSession, sf: str) -> DataFrame:
    features = ll_table(spark, sf).select("ID", "grid_pos", "feature")
    return _tuned(_with_label(spark, sf, features))


# -- output distribution ---------------------------------------------------------------------------

DISTANCES = (
    *Q.GENERATED,
    f"""dist AS (SELECT ID, sample_no, greedy, sample, {S.distance('greedy', 'sample')} AS d FROM gen WHERE sample IS NOT NULL),
longest AS (SELECT ID, greatest(len(any_value(greedy)), coalesce(max(len(sample)), 0)) AS ml FROM gen GROUP BY ID)""",
)
CDD = (
    *DISTANCES,
    _values("al", ALPHAS),
    """cddf AS (SELECT l.ID, grid_pos, v AS alpha,
  coalesce(avg(CASE WHEN d IS NULL THEN NULL WHEN d <= v * ml THEN 1::DOUBLE ELSE 0 END), 0) AS x
  FROM longest l CROSS JOIN al LEFT JOIN dist ON dist.ID = l.ID GROUP BY l.ID, grid_pos, v)""",
)


@query(
    "token_edit_distance",
    S.with_(*DISTANCES)
    + "SELECT ID, (sample_no - 1)::INTEGER AS sample, d::INTEGER AS distance FROM dist",
)
def token_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    return (
        D.sample_distances(Q.generations(spark, sf))
        .where("sample is not null")
        .select("ID", "sample", "distance")
    )


@query(
    "rho_star",
    S.with_(*DISTANCES)
    + """SELECT ID, d::INTEGER AS distance, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY ID), 9) AS share
  FROM dist GROUP BY ID, d""",
)
def rho_star(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        D.rho_star(D.sample_distances(Q.generations(spark, sf)), ["ID"]),
        ["ID", "distance"], 9, "share",
    )


@query(
    "cdd_features",
    S.with_(*CDD) + "SELECT ID, alpha, round(x, 9) AS feature FROM cddf",
)
def cdd_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(D.cdd_features(Q.generations(spark, sf), ALPHAS), ["ID", "alpha"])


@query(
    "tune_cdd",
    S.with_(*CDD, S.LABELS, "feat AS (SELECT grid_pos, ID, y, x FROM cddf JOIN lab USING (ID))", S.cv(), S.TUNED),
)
def tune_cdd(spark: SparkSession, sf: str) -> DataFrame:
    return _tuned(_with_label(spark, sf, D.cdd_features(Q.generations(spark, sf), ALPHAS)))


START_CDD = (
    *Q.START_GENERATED,
    "ns(n) AS (VALUES " + ", ".join(f"({n})" for n in CDD_NS) + ")",
    f"""cutg AS (SELECT ID, slot, n, sample_no, greedy[1:n] AS g, sample[1:n] AS s FROM gen CROSS JOIN ns),
sd AS (SELECT ID, slot, n, CASE WHEN s IS NOT NULL THEN {S.distance('g', 's')} END AS d, g, s FROM cutg),
ml AS (SELECT ID, slot, n, greatest(len(any_value(g)), coalesce(max(len(s)), 0)) AS ml FROM sd GROUP BY ID, slot, n)""",
    _values("al", ALPHAS),
    f"""peak AS (SELECT ID, slot, n, grid_pos AS ap, v AS alpha,
  coalesce(avg(CASE WHEN d IS NULL THEN NULL WHEN d <= v * ml THEN 1::DOUBLE ELSE 0 END), 0) AS p
  FROM sd JOIN ml USING (ID, slot, n) CROSS JOIN al GROUP BY ID, slot, n, grid_pos, v),
ncf AS (SELECT ID, n, alpha, (list_position([{', '.join(map(str, CDD_NS))}], n) - 1) * {len(ALPHAS)} + ap AS grid_pos, avg(p) AS x
  FROM peak GROUP BY ID, n, alpha, ap)""",
)


@query(
    "cut_generations",
    S.with_(*START_CDD)
    + """SELECT ID, slot::INTEGER AS slot, n, array_to_string(any_value(g), ' ') AS greedy_text,
  count(s)::INTEGER AS n_samples, sum(coalesce(len(s), 0))::BIGINT AS sample_tokens, any_value(m.ml)::INTEGER AS max_length
  FROM sd JOIN ml m USING (ID, slot, n) GROUP BY ID, slot, n""",
)
def cut_generations(spark: SparkSession, sf: str) -> DataFrame:
    return D.cut_generations(Q.start_generations(spark, sf), CDD_NS).select(
        "ID", "slot", "n",
        F.array_join("GREEDY_IDS", " ").alias("greedy_text"),
        F.size("SAMPLE_IDS").alias("n_samples"),
        F.expr("aggregate(SAMPLE_IDS, 0L, (acc, s) -> acc + size(s))").alias("sample_tokens"),
        F.col("MAX_LENGTH").alias("max_length"),
    )


@query(
    "ngram_cdd_features",
    S.with_(*START_CDD) + "SELECT ID, n, alpha, round(x, 9) AS feature FROM ncf",
)
def ngram_cdd_features(spark: SparkSession, sf: str) -> DataFrame:
    features = D.ngram_cdd_features(Q.start_generations(spark, sf), CDD_NS, ALPHAS)
    return _rounded(features, ["ID", "n", "alpha"])


@query(
    "tune_ngram_cdd",
    S.with_(*START_CDD, S.LABELS, "feat AS (SELECT grid_pos, ID, y, x FROM ncf JOIN lab USING (ID))", S.cv(), S.TUNED),
)
def tune_ngram_cdd(spark: SparkSession, sf: str) -> DataFrame:
    features = D.ngram_cdd_features(Q.start_generations(spark, sf), CDD_NS, ALPHAS)
    return _tuned(_with_label(spark, sf, features))


# -- curves -----------------------------------------------------------------------------------------

CURVES = (
    *Q.SCORED,
    """cumt AS (SELECT ID, pos, log_like, sum(log_like) OVER (PARTITION BY ID ORDER BY pos) AS cum FROM scores),
normt AS (SELECT ID, pos, cum, (cum - first_value(cum) OVER (PARTITION BY ID ORDER BY pos)) / count(*) OVER (PARTITION BY ID) AS norm FROM cumt),
lin AS (SELECT ID, sum(pos * norm) / sum(pos * pos) AS m FROM normt GROUP BY ID)""",
)


# Half the spacing of doubles at 1 is exp(-53 ln 2): steeper curves are steps in double precision.
_STEEP = "(53 * ln(2::DOUBLE))"
_DOWN = "(least(b, 0) * (m - 1))"  # a scale that keeps exponents below zero


def _factorial(j: int) -> str:
    return f"{math.factorial(j)}::DOUBLE"


# phi = (1 - exp(-b x)) / b and its slope in b, by their power series where b x is small.
_PHI = (
    f"CASE WHEN abs(b * pos) < 0.1 THEN exp({_DOWN}) * pos * ("
    + " + ".join(f"pow(-b * pos, {j}) / {_factorial(j + 1)}" for j in range(10))
    + f") ELSE (exp({_DOWN}) - exp({_DOWN} - b * pos)) / b END"
)
_SLOPE = (
    f"CASE WHEN abs(b * pos) < 0.1 THEN -exp({_DOWN}) * pos * pos * ("
    + " + ".join(f"pow(-b * pos, {j}) / ({_factorial(j)} * {j + 2})" for j in range(10))
    + f") ELSE (exp({_DOWN} - b * pos) * (1 + b * pos) - exp({_DOWN})) / (b * b) END"
)

# A dense scan of signed rates, then halving between the neighbours of the best one.
FITS = (
    *CURVES,
    f"""shape AS (SELECT ID, count(*) AS m, max(pos) AS last, sum(pos * norm) ** 2 / nullif(sum(pos * pos), 0) AS line,
  sum(norm) FILTER (pos > 0) AS body, max(norm) FILTER (pos = m1) AS tail, sum(norm * norm) AS yy
  FROM (SELECT *, max(pos) OVER (PARTITION BY ID) AS m1 FROM normt) GROUP BY ID),
scan AS (SELECT ID, m, sgn * exp(ln(0.003 / (m - 1)) + (ln({_STEEP}) - ln(0.003 / (m - 1))) * k / 300) AS b
  FROM shape, (SELECT unnest(range(0, 301)) AS k), (SELECT unnest([-1, 1]) AS sgn) WHERE m > 1),
scored AS (SELECT ID, b, sum(p * norm) ** 2 / sum(p * p) AS gain FROM
  (SELECT ID, b, norm, {_PHI} AS p FROM scan JOIN normt USING (ID)) GROUP BY ID, b
  UNION ALL SELECT ID, 0, line FROM shape WHERE m > 1),
sides AS (SELECT *, coalesce(lag(b) OVER w, b) AS lo, coalesce(lead(b) OVER w, b) AS hi FROM scored WINDOW w AS (PARTITION BY ID ORDER BY b)),
peak AS (SELECT ID, max_by(lo, gain) AS lo, max_by(hi, gain) AS hi FROM sides GROUP BY ID),
halved(ID, step, lo, hi) AS (SELECT ID, 0, lo, hi FROM peak
  UNION ALL
  SELECT ID, step + 1, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END FROM (
    SELECT ID, step, lo, hi, b AS mid, sum(p * norm) * (sum(d * norm) * sum(p * p) - sum(p * norm) * sum(p * d)) > 0 AS up FROM (
      SELECT *, {_PHI} AS p, {_SLOPE} AS d FROM (
        SELECT h.ID, step, lo, hi, (lo + hi) / 2 AS b, m, pos, norm FROM halved h JOIN shape USING (ID) JOIN normt USING (ID) WHERE step < 90))
    GROUP BY ID, step, lo, hi, b)),
inner_fit AS (SELECT ID, b, sum(p * norm) ** 2 / sum(p * p) AS gain FROM
  (SELECT ID, b, norm, {_PHI} AS p FROM (SELECT ID, (lo + hi) / 2 AS b FROM halved WHERE step = 90) JOIN shape USING (ID) JOIN normt USING (ID))
  GROUP BY ID, b),
rate AS (SELECT ID, m, CASE WHEN yy = 0 THEN NULL WHEN line >= top THEN 0 WHEN body * body / (m - 1) >= top THEN {_STEEP}
  WHEN tail * tail >= top THEN -{_STEEP} ELSE b END AS b
  FROM (SELECT *, greatest(gain, line, body * body / (m - 1), tail * tail) * (1 - 1e-12) AS top FROM shape JOIN inner_fit USING (ID))),
fit AS (SELECT ID, CASE WHEN b <> 0 THEN a END AS A_value, b AS B_value FROM shape LEFT JOIN (
  SELECT ID, b, -sum(p * norm) / sum(p * p) * exp({_DOWN}) / b AS a FROM
    (SELECT ID, b, m, norm, {_PHI} AS p FROM rate JOIN normt USING (ID)) GROUP BY ID, b, m) USING (ID))""",
)
# Six significant digits.
SIX = "CAST(printf('%.5e', {0}) AS DOUBLE)".format


@query(
    "cum_loglike",
    S.with_(*CURVES) + "SELECT ID, pos::INTEGER AS pos, round(cum, 6) AS cum FROM cumt",
)
def cum_loglike(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(D.cum_loglike(Q.scores(spark, sf)), ["ID", "pos"], 6, "cum")


@query(
    "norm_cum_loglike",
    S.with_(*CURVES) + "SELECT ID, pos::INTEGER AS pos, round(norm, 6) AS norm FROM normt",
)
def norm_cum_loglike(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(D.norm_cum_loglike(Q.scores(spark, sf)), ["ID", "pos"], 6, "norm")


@query("fit_linear", S.with_(*CURVES) + "SELECT ID, round(m, 6) AS m_value FROM lin")
def fit_linear(spark: SparkSession, sf: str) -> DataFrame:
    fitted = D.curve_features(D.curves(Q.scores(spark, sf)), "linear")
    return _rounded(fitted, ["ID"], 6, "m_value")


def _fitted(curves: DataFrame) -> DataFrame:
    """Exponential fits to six significant digits."""
    both = D.fit_exponential(curves)
    return both.withColumns(
        {c: F.format_string("%.5e", c).cast("double") for c in ("A_value", "B_value")}
    ).drop("curve")


@query(
    "fit_exponential",
    S.with_(*FITS, recursive=True) + f"SELECT ID, {SIX('A_value')} AS A_value, {SIX('B_value')} AS B_value FROM fit",
)
def fit_exponential(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(D.curves(Q.scores(spark, sf)))


@query(
    "curve_features",
    S.with_(*FITS, recursive=True)
    + f"""SELECT ID, round(m, 6) AS m_value, coalesce({SIX('A_value')}, 0) AS A_value, coalesce({SIX('B_value')}, 0) AS B_value
  FROM fit JOIN lin USING (ID)""",
)
def curve_features(spark: SparkSession, sf: str) -> DataFrame:
    linear = D.curves(Q.scores(spark, sf)).withColumn("m_value", F.round(D.fit_linear(F.col("curve")), 6))
    return D.clean_features(_fitted(linear), ["A_value", "B_value"])


@query(
    "tune_curve",
    S.with_(
        *FITS, S.LABELS,
        f"""feat2 AS (SELECT 0 AS grid_pos, ID, y, coalesce({SIX('A_value')}, 0) AS a, coalesce({SIX('B_value')}, 0) AS b
  FROM fit JOIN lab USING (ID))""",
        S.cv_pair(),
        recursive=True,
    )
    + f"""SELECT grid_pos, {SIX('round(max(ta) FILTER (f = -1), 6)')} AS global_threshold_1, {SIX('round(max(tb) FILTER (f = -1), 6)')} AS global_threshold_2,
  round(avg(train_acc) FILTER (f >= 0), 6) AS mean_cvacc_train, round(avg(test_acc) FILTER (f >= 0), 6) AS mean_cvacc_test
  FROM cvr GROUP BY grid_pos""",
)
def tune_curve(spark: SparkSession, sf: str) -> DataFrame:
    fitted = _fitted(D.curves(Q.scores(spark, sf)))
    features = D.clean_features(fitted, ["A_value", "B_value"]).withColumn("grid_pos", F.lit(0))
    tuned = tune_pair(_with_label(spark, sf, features))
    return tuned.select(
        "grid_pos",
        *[F.format_string("%.5e", c).cast("double").alias(c) for c in ("global_threshold_1", "global_threshold_2")],
        "mean_cvacc_train", "mean_cvacc_test",
    )


@query(
    "perplexity",
    S.with_(*Q.TOKENS) + "SELECT ID, round(exp(-list_avg(lls)), 4) AS perplexity FROM td",
)
def perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return Q.token_data(spark, sf).select(
        "ID", F.round(D.perplexity(F.col("token_log_likes")), 4).alias("perplexity")
    )


THETA = 1e-5


@query(
    "mink_flagship",
    S.with_(*MINK, S.LABELS)
    + f"""SELECT CATEGORY, count(*) AS n, sum(CASE WHEN y = 0 AND NOT p THEN 1 ELSE 0 END)::BIGINT AS tn,
  sum(CASE WHEN y = 0 AND p THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN y = 1 AND NOT p THEN 1 ELSE 0 END)::BIGINT AS fn,
  sum(CASE WHEN y = 1 AND p THEN 1 ELSE 0 END)::BIGINT AS tp, round(avg(CASE WHEN p = (y = 1) THEN 1::DOUBLE ELSE 0 END), 9) AS accuracy
  FROM (SELECT CATEGORY, y, coalesce(x > {THETA!r}::DOUBLE, FALSE) AS p FROM minkf JOIN lab USING (ID) WHERE k = 20) GROUP BY CATEGORY""",
)
def mink_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """From raw documents to detection quality per category in one plan."""
    items, docs = T.items(spark, sf), T.corpus(spark, sf)
    counts = C.item_counts(items, docs, (2, 8))  # one pass for scores and labels
    features = D.mink_features(C.token_data(items, C.token_scores(items, docs, counts=counts)), [20])
    labels = C.overlap_label(items, docs, counts=counts).select("ID", "LABEL_BINARY")
    scored = M.predict(features.join(labels, "ID"), "feature", THETA, "minK")
    return M.classification_metrics(scored, "minK", by=["CATEGORY"]).selectExpr(
        "CATEGORY", "tn + fp + fn + tp as n", "tn", "fp", "fn", "tp",
        "round(accuracy, 9) as accuracy",
    )
