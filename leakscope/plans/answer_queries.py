"""Queries over graded answers, prompts and text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakscope.functions import text as X
from leakscope.operators import answers as AN
from leakscope.operators import metrics as M
from leakscope.operators import shape
from leakscope.plans import sql as S
from leakscope.plans.registry import query
from leakscope.sources import tables as T

COR = S.CORRECT


def _mean_ci(name: str, by: list[str]) -> None:
    cols = ", ".join(by)
    sql = S.with_(COR) + (
        f"SELECT {cols}, round(avg(CORRECTNESS), 9) AS mean, "
        f"round(1.96::DOUBLE * stddev_samp(CORRECTNESS) / sqrt(count(*)), 9) AS ci, count(*) AS n FROM cor GROUP BY {cols}"
    )

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return M.mean_ci(T.correctness(spark, sf), by, "CORRECTNESS").select(
            *by, F.round("mean", 9).alias("mean"), F.round("ci", 9).alias("ci"), "n"
        )


_mean_ci("mean_ci_by_label", ["LABEL"])
_mean_ci("mean_ci_by_category", ["CATEGORY", "LABEL"])
_mean_ci("mean_ci_by_model", ["MODEL_SHORT", "LABEL"])


@query(
    "performance_gap",
    S.with_(COR, S.mann_whitney("cor", "MODEL_SHORT", "CORRECTNESS"))
    + """SELECT MODEL_SHORT, round(avg(CORRECTNESS) FILTER (LABEL = 'Conta'), 9) AS acc_conta,
  round(avg(CORRECTNESS) FILTER (LABEL = 'Clean'), 9) AS acc_clean,
  round(avg(CORRECTNESS) FILTER (LABEL = 'Conta') - avg(CORRECTNESS) FILTER (LABEL = 'Clean'), 9) AS gap,
  round(any_value(p_value), 7) AS p_value FROM cor JOIN mw USING (MODEL_SHORT) GROUP BY MODEL_SHORT""",
)
def performance_gap(spark: SparkSession, sf: str) -> DataFrame:
    return M.performance_gap(T.correctness(spark, sf)).select(
        "MODEL_SHORT", *[F.round(c, 9).alias(c) for c in ("acc_conta", "acc_clean", "gap")],
        F.round("p_value", 7).alias("p_value"),
    )


@query(
    "mann_whitney",
    S.with_(
        """src AS (SELECT lang, CASE WHEN toxic = 1 THEN 'Conta' ELSE 'Clean' END AS LABEL, n_chars AS v
  FROM documents JOIN labels USING (doc_id))""",
        S.mann_whitney("src", "lang", "v"),
    )
    + "SELECT lang, n1, n2, round(u1, 6) AS u1, round(p_value, 7) AS p_value FROM mw",
)
def mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    labelled = docs.join(T.table(spark, sf, "labels"), "doc_id").withColumn(
        "LABEL", F.when(F.col("toxic") == 1, "Conta").otherwise("Clean")
    )
    return M.mann_whitney(labelled, ["lang"], "LABEL", "n_chars", "Conta", "Clean").select(
        "lang", "n1", "n2", F.round("u1", 6).alias("u1"), F.round("p_value", 7).alias("p_value")
    )


@query(
    "gap_pivot",
    S.with_(COR)
    + """SELECT CATEGORY, round(avg(CORRECTNESS) FILTER (LABEL = 'Conta'), 9) AS Conta_mean,
  round(1.96::DOUBLE * stddev_samp(CORRECTNESS) FILTER (LABEL = 'Conta') / sqrt(count(*) FILTER (LABEL = 'Conta')), 9) AS Conta_ci,
  round(avg(CORRECTNESS) FILTER (LABEL = 'Clean'), 9) AS Clean_mean,
  round(1.96::DOUBLE * stddev_samp(CORRECTNESS) FILTER (LABEL = 'Clean') / sqrt(count(*) FILTER (LABEL = 'Clean')), 9) AS Clean_ci,
  round(abs(avg(CORRECTNESS) FILTER (LABEL = 'Conta') - avg(CORRECTNESS) FILTER (LABEL = 'Clean')), 9) AS gap FROM cor GROUP BY CATEGORY""",
)
def gap_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = M.gap_pivot(T.correctness(spark, sf), "CATEGORY", absolute=True)
    return wide.select("CATEGORY", *[F.round(c, 9).alias(c) for c in wide.columns if c != "CATEGORY"])


@query(
    "gap_sorted",
    S.with_(COR)
    + """SELECT MODEL_SHORT, round(c, 9) AS Conta_mean, round(k, 9) AS Clean_mean, round(c - k, 9) AS gap,
  row_number() OVER (ORDER BY c DESC NULLS LAST, MODEL_SHORT) - 1 AS place
  FROM (SELECT MODEL_SHORT, avg(CORRECTNESS) FILTER (LABEL = 'Conta') AS c, avg(CORRECTNESS) FILTER (LABEL = 'Clean') AS k FROM cor GROUP BY MODEL_SHORT)""",
)
def gap_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Signed gaps per model, models with the highest contaminated accuracy first."""
    wide = M.gap_pivot(T.correctness(spark, sf), "MODEL_SHORT")
    means = ("Conta_mean", "Clean_mean", "gap")
    return M.by_contaminated_mean(wide, "MODEL_SHORT").select(
        "MODEL_SHORT", *[F.round(c, 9).alias(c) for c in means], "place"
    )


_SCORES = """sc AS (SELECT MODEL_SHORT, CATEGORY, avg(CORRECTNESS) AS acc, count(*) AS n FROM cor GROUP BY MODEL_SHORT, CATEGORY),
pos AS (SELECT *, list_position(['en', 'fr', 'de', 'es'], CATEGORY) AS grid_pos FROM sc)"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(c) for c in ("en", "fr", "de", "es")]), F.col("CATEGORY"))
    return (
        T.correctness(spark, sf)
        .groupBy("MODEL_SHORT", "CATEGORY")
        .agg(F.avg("CORRECTNESS").alias("acc"), F.count(F.lit(1)).alias("n"))
        .withColumn("grid_pos", place.cast("int"))
    )


@query(
    "best_per_group",
    S.with_(COR, _SCORES)
    + """SELECT MODEL_SHORT, CATEGORY, round(acc, 9) AS acc, n FROM pos
  QUALIFY row_number() OVER (PARTITION BY MODEL_SHORT ORDER BY acc DESC, grid_pos) = 1""",
)
def best_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return shape.best_per_group(_scores(spark, sf), ["MODEL_SHORT"], "acc", "grid_pos").select(
        "MODEL_SHORT", "CATEGORY", F.round("acc", 9).alias("acc"), "n"
    )


@query(
    "accuracy_matrix",
    S.with_(COR)
    + "SELECT MODEL_SHORT, "
    + ", ".join(
        f"round(avg(CORRECTNESS) FILTER (CATEGORY = '{c}'), 9) AS {c}" for c in ("en", "fr", "de", "es")
    )
    + " FROM cor GROUP BY MODEL_SHORT",
)
def accuracy_matrix(spark: SparkSession, sf: str) -> DataFrame:
    from leakscope.operators.report import accuracy_matrix as matrix

    wide = matrix(
        _scores(spark, sf), "MODEL_SHORT", "CATEGORY", "acc", None, ["en", "fr", "de", "es"]
    )
    return wide.select("MODEL_SHORT", *[F.round(c, 9).alias(c) for c in ("en", "fr", "de", "es")])


@query(
    "custom_order",
    S.with_(COR)
    + """SELECT ID, CATEGORY, coalesce(nullif(list_position(['fr', 'en', 'es'], CATEGORY), 0), 4)::INTEGER AS order_key FROM cor""",
)
def custom_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.correctness(spark, sf).select("ID", "CATEGORY")
    return shape.order_by_list(rows, "CATEGORY", ["fr", "en", "es"], "ID")


@query(
    "line_accuracy",
    S.with_(COR)
    + """SELECT count(*) AS total, count(*) FILTER ((LABEL = 'Conta') = (CORRECTNESS = 1)) AS correct,
  round(count(*) FILTER ((LABEL = 'Conta') = (CORRECTNESS = 1))::DOUBLE / count(*), 9) AS accuracy FROM cor""",
)
def line_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    lines = T.correctness(spark, sf).select(
        (F.col("LABEL") == "Conta").alias("output"), (F.col("CORRECTNESS") == 1).alias("label")
    )
    return M.line_accuracy(lines).withColumn("accuracy", F.round("accuracy", 9))


@query(
    "union_models",
    """SELECT 'bench' AS model_id, item_id AS ID, length(text)::INTEGER AS n FROM benchmark
  UNION ALL SELECT 'docs' AS model_id, doc_id AS ID, length(text)::INTEGER AS n FROM documents""",
)
def union_models(spark: SparkSession, sf: str) -> DataFrame:
    bench = T.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ID"), F.length("text").alias("n")
    )
    docs = T.table(spark, sf, "documents").select(
        F.col("doc_id").alias("ID"), F.length("text").alias("n")
    )
    return shape.union_models({"bench": bench, "docs": docs}).select("model_id", "ID", "n")


@query(
    "filter_models",
    S.with_(COR)
    + "SELECT ID, MODEL_SHORT FROM cor WHERE contains(MODEL_SHORT, 'src1') AND MODEL_SHORT <> 'src11'",
)
def filter_models(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.correctness(spark, sf).select("ID", "MODEL_SHORT")
    return shape.filter_models(rows, contains="src1", drop="src11", column="MODEL_SHORT")


@query(
    "rename_values",
    S.with_(COR)
    + """SELECT ID, CASE MODEL_SHORT WHEN 'src0' THEN 'alpha' WHEN 'src1' THEN 'beta' ELSE MODEL_SHORT END AS MODEL_SHORT FROM cor""",
)
def rename_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.correctness(spark, sf).select("ID", "MODEL_SHORT")
    return shape.rename_values(rows, "MODEL_SHORT", {"src0": "alpha", "src1": "beta"})


@query(
    "override_values",
    """SELECT d.doc_id AS ID, coalesce(CASE WHEN l.toxic = 1 THEN 'flagged' END, d.source) AS source
  FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def override_values(spark: SparkSession, sf: str) -> DataFrame:
    docs = T.table(spark, sf, "documents").select(F.col("doc_id").alias("ID"), "source")
    fixes = T.table(spark, sf, "labels").select(
        F.col("doc_id").alias("ID"), F.when(F.col("toxic") == 1, "flagged").alias("source")
    )
    return shape.override(docs, fixes, ["source"])


@query(
    "model_name",
    """SELECT regexp_extract(url, '[^/]*$') AS name, count(*) AS n FROM pages GROUP BY 1""",
)
def model_name(spark: SparkSession, sf: str) -> DataFrame:
    pages = T.table(spark, sf, "pages").select(X.model_name(F.col("url")).alias("name"))
    return pages.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


# -- conversations -------------------------------------------------------------------------------


@query(
    "left_join_answers",
    S.with_(S.QA) + "SELECT conv_id, turn, PROBLEM, SOLUTION FROM qa",
)
def left_join_answers(spark: SparkSession, sf: str) -> DataFrame:
    pairs = T.exchanges(spark, sf).withColumn("ID", F.concat_ws("-", "conv_id", "turn"))
    verbose = pairs.where("SOLUTION is not null").select("ID", "SOLUTION")
    return shape.with_answers(pairs.drop("SOLUTION"), verbose).select(
        "conv_id", "turn", "PROBLEM", "SOLUTION"
    )


@query(
    "detector_text",
    S.with_(S.QA)
    + """SELECT conv_id, turn, md5(PROBLEM || coalesce(SOLUTION, '')) AS joined, md5(concat_ws(' ', PROBLEM, SOLUTION)) AS spaced
  FROM qa""",
)
def detector_text(spark: SparkSession, sf: str) -> DataFrame:
    p, s = F.col("PROBLEM"), F.col("SOLUTION")
    return T.exchanges(spark, sf).select(
        "conv_id", "turn", F.md5(X.detector_text(p, s)).alias("joined"),
        F.md5(X.detector_text(p, s, "spaced")).alias("spaced"),
    )


@query(
    "boxed_items",
    r"""SELECT conv_id, turn, len(found)::INTEGER AS n_boxed, array_to_string(found, '|') AS boxed FROM (
  SELECT conv_id, turn, regexp_extract_all(text || ' \boxed{' || role || '} or \boxed {\frac{' || turn || '}{2}}',
    '\\boxed\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}', 1) AS found FROM conversations)""",
)
def boxed_items(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        "text", F.lit(" \\boxed{"), "role", F.lit("} or \\boxed {\\frac{"),
        F.col("turn").cast("string"), F.lit("}{2}}"),
    )
    return T.table(spark, sf, "conversations").select(
        "conv_id", "turn", X.boxed_items(text).alias("found")
    ).select(
        "conv_id", "turn", F.size("found").alias("n_boxed"), F.array_join("found", "|").alias("boxed")
    )


@query(
    "mask_symbols",
    """SELECT conv_id, turn, array_to_string(list_transform(string_split(text, ' '),
  lambda w: regexp_replace(w, '[^A-Za-z0-9]', '*', 'g')), ' ') AS masked FROM conversations""",
)
def mask_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return T.table(spark, sf, "conversations").select(
        "conv_id", "turn",
        F.array_join(X.mask_symbols(F.split("text", " ", -1)), " ").alias("masked"),
    )


@query(
    "char_edit_distance",
    """WITH m AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z0-9]', '*', 'g') AS t FROM conversations)
SELECT b.conv_id, b.turn, levenshtein(a.t, b.t)::INTEGER AS distance FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn""",
)
def char_edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn against the turn before it, whole texts with symbols masked."""
    turns = T.spread(T.table(spark, sf, "conversations"), "conv_id").select(
        "conv_id", "turn", F.regexp_replace("text", "[^A-Za-z0-9]", "*").alias("t")
    )
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = turns.select(
        "conv_id", "turn", "t", F.lag("t").over(w).alias("before"), F.lag("turn").over(w).alias("pt")
    ).where(F.col("pt") + 1 == F.col("turn"))
    return pairs.select("conv_id", "turn", F.levenshtein("before", "t").alias("distance"))


SHOTS = 3


def _qa(spark: SparkSession, sf: str) -> DataFrame:
    return T.exchanges(spark, sf).select(
        F.concat_ws("-", "conv_id", "turn").alias("ID"),
        F.struct("conv_id", "turn").alias("place"),
        F.when(F.length("PROBLEM") < 200, "short").otherwise("long").alias("CATEGORY"),
        "PROBLEM", "SOLUTION",
        F.element_at(F.split("SOLUTION", " "), 1).alias("EXTRACTED_ANSWER"),
    )


def _prompts(spark: SparkSession, sf: str, model: str) -> DataFrame:
    """Few-shot prompts for every user turn; answered turns serve as shots."""
    return AN.add_prompts(_qa(spark, sf), SHOTS, model, "place", donors="SOLUTION is not null")


_STEP, _LEAD = S.text(X.STEP_SUFFIX), S.text(X.STEP_LEAD)
_SHOT_SQL = (
    S.QA,
    f"""item AS (SELECT conv_id || '-' || turn AS ID, conv_id, turn, CASE WHEN length(PROBLEM) < 200 THEN 'short' ELSE 'long' END AS CATEGORY, PROBLEM,
  CASE WHEN length(string_split(SOLUTION, ' ')[1]) > 0
    THEN SOLUTION || {S.text(X.SHOT_CLOSING)} || string_split(SOLUTION, ' ')[1] || '}}.' ELSE SOLUTION END AS shot FROM qa),
num AS (SELECT *, row_number() OVER (PARTITION BY CATEGORY ORDER BY conv_id, turn) - 1 AS idx, count(*) OVER (PARTITION BY CATEGORY) AS n
  FROM item WHERE shot IS NOT NULL),
head AS (SELECT CATEGORY, list(struct_pack(q := PROBLEM, a := shot, id := ID) ORDER BY idx) AS s FROM num WHERE idx < {SHOTS} GROUP BY CATEGORY),
tail AS (SELECT CATEGORY, list(struct_pack(q := PROBLEM, a := shot, id := ID) ORDER BY idx) AS s FROM num WHERE idx >= n - {SHOTS} GROUP BY CATEGORY),
shotted AS (SELECT item.ID, item.CATEGORY, item.PROBLEM, CASE WHEN num.idx < {SHOTS} THEN tail.s ELSE head.s END AS s
  FROM item LEFT JOIN num USING (ID) JOIN head ON head.CATEGORY = item.CATEGORY JOIN tail ON tail.CATEGORY = item.CATEGORY)""",
)


@query(
    "few_shot_prompts",
    S.with_(*_SHOT_SQL)
    + f"""SELECT ID, array_to_string(list_transform(s, lambda x: x.id), ',') AS shot_ids,
  md5('system:{X.SYSTEM_TEXT}' || chr(10) || array_to_string(list_transform(s, lambda x: 'user:' || x.q || {_STEP} || chr(10) || 'assistant:' || x.a), chr(10))
  || chr(10) || 'user:' || PROBLEM || {_STEP}) AS prompt_md5 FROM shotted""",
)
def few_shot_prompts(spark: SparkSession, sf: str) -> DataFrame:
    flat = F.array_join(
        F.transform("formatted_prompt", lambda t: F.concat_ws(":", t["role"], t["content"])), "\n"
    )
    return _prompts(spark, sf, "olmo-chat").select(
        "ID", F.array_join("shot_ids", ",").alias("shot_ids"), F.md5(flat).alias("prompt_md5")
    )


@query(
    "prompt_plain",
    S.with_(*_SHOT_SQL)
    + f"""SELECT ID, array_to_string(list_transform(s, lambda x: 'Q: ' || x.q || {_LEAD} || ' ' || x.a), chr(10) || chr(10))
  || chr(10) || chr(10) || 'Q: ' || PROBLEM || {_LEAD} AS formatted_prompt FROM shotted""",
)
def prompt_plain(spark: SparkSession, sf: str) -> DataFrame:
    made = AN.add_plain_prompts(_qa(spark, sf), SHOTS, "place", donors="SOLUTION is not null")
    return made.select("ID", "formatted_prompt")


@query(
    "prompt_chat",
    S.with_(*_SHOT_SQL)
    + f"""SELECT ID, (2 * k)::INTEGER AS pos, 'user' AS role, s[k + 1].q || {_STEP} AS content FROM shotted, (SELECT unnest(range(0, {SHOTS})) AS k)
UNION ALL SELECT ID, (2 * k + 1)::INTEGER, 'assistant', s[k + 1].a FROM shotted, (SELECT unnest(range(0, {SHOTS})) AS k)
UNION ALL SELECT ID, {2 * SHOTS}::INTEGER, 'user', PROBLEM || {_STEP} FROM shotted""",
)
def prompt_chat(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts(spark, sf, "deepseek-chat").select(
        "ID", F.posexplode("formatted_prompt").alias("pos", "t")
    ).select("ID", "pos", "t.role", "t.content")


@query(
    "zero_shot_prompts",
    S.with_(S.QA)
    + f"""SELECT conv_id || '-' || turn AS ID, md5({S.text(X.ZERO_SHOT_TEMPLATE.replace("{question}", ""))} || PROBLEM) AS prompt_md5 FROM qa""",
)
def zero_shot_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return _qa(spark, sf).select(
        "ID", F.md5(X.fill_template(X.ZERO_SHOT_TEMPLATE, F.col("PROBLEM"))).alias("prompt_md5")
    )
