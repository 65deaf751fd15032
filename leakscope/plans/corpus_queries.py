"""Queries over benchmark items and the document corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions import arrays as A
from leakscope.operators import corpus as C
from leakscope.plans import sql as S
from leakscope.plans.registry import query
from leakscope.sources import tables as T

CONTEXT, NGRAM, STARTS, OFFSET = 2, 3, 5, 5
CDD_LENGTH, CDD_SAMPLES = 12, 20
START_LENGTH, START_POINTS = 10, 3


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return C.token_scores(T.items(spark, sf), T.corpus(spark, sf))


def token_data(spark: SparkSession, sf: str) -> DataFrame:
    items = T.items(spark, sf)
    return C.token_data(items, C.token_scores(items, T.corpus(spark, sf)))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return C.overlap_label(T.items(spark, sf), T.corpus(spark, sf)).select(
        "ID", "LABEL", "LABEL_BINARY"
    )


def ngram_rows(spark: SparkSession, sf: str, samples: int = 0) -> DataFrame:
    items = T.items(spark, sf)
    points = A.start_points_even(F.size("tokens"), NGRAM, STARTS, OFFSET)
    return C.predictions(items, T.corpus(spark, sf), points, CONTEXT, NGRAM, samples)


def start_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy and sampled outputs after each of a few start points."""
    points = A.start_points_even(F.size("tokens"), START_LENGTH, START_POINTS, OFFSET)
    rows = C.predictions(
        T.items(spark, sf), T.corpus(spark, sf), points, CONTEXT, START_LENGTH, CDD_SAMPLES
    )
    return rows.select(
        "ID", "slot", F.col("greedy").alias("GREEDY_IDS"),
        F.coalesce("samples", F.array().cast("array<array<string>>")).alias("SAMPLE_IDS"),
    )


def generations(spark: SparkSession, sf: str) -> DataFrame:
    return C.cdd_generation(
        T.items(spark, sf), T.corpus(spark, sf), CONTEXT, CDD_LENGTH, CDD_SAMPLES
    )


# -- SQL shared by the corpus queries ------------------------------------------------------

SCORED = (S.DOCS, S.ITEMS, S.SCORES)
TOKENS = (*SCORED, S.TOKEN_DATA)

PREDICTED = (
    S.DOCS,
    S.ITEMS,
    S.starts_table(NGRAM, STARTS, OFFSET, CONTEXT),
    S.continuations("at_start", CONTEXT, NGRAM, 0),
)

GENERATED = (
    S.DOCS,
    S.ITEMS,
    f"""ctx AS (SELECT ID, array_to_string(tokens[greatest(plen - {CONTEXT} + 1, 1):plen], ' ') AS context FROM items)""",
    S.continuations("ctx", CONTEXT, CDD_LENGTH, CDD_SAMPLES),
    """gen AS (SELECT ID, NULL::BIGINT AS slot, coalesce(g.greedy, []) AS greedy, d.r AS sample_no, d.sample
  FROM ctx LEFT JOIN greedy g USING (context) LEFT JOIN drawn d USING (context))""",
)

START_GENERATED = (
    S.DOCS,
    S.ITEMS,
    S.starts_table(START_LENGTH, START_POINTS, OFFSET, CONTEXT),
    S.continuations("at_start", CONTEXT, START_LENGTH, CDD_SAMPLES),
    """gen AS (SELECT ID, slot, coalesce(g.greedy, []) AS greedy, d.r AS sample_no, d.sample
  FROM at_start LEFT JOIN greedy g USING (context) LEFT JOIN drawn d USING (context))""",
)


# -- queries ---------------------------------------------------------------------------------


@query(
    "ngram_counts",
    S.with_(S.DOCS)
    + " UNION ALL ".join(
        f"SELECT {n}::INTEGER AS n, gram, count(*) AS n_seen FROM "
        f"(SELECT unnest({S.grams('tokens', n)}) AS gram FROM docs) GROUP BY gram"
        for n in (1, 2, 3)
    ),
)
def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.all_ngram_counts(T.corpus(spark, sf))


@query(
    "overlap_label",
    S.with_(S.DOCS, S.ITEMS, S.LABELS)
    + "SELECT ID, CATEGORY, CASE WHEN y = 1 THEN 'Conta' ELSE 'Clean' END AS LABEL, y AS LABEL_BINARY FROM lab",
)
def overlap_label(spark: SparkSession, sf: str) -> DataFrame:
    return C.overlap_label(T.items(spark, sf), T.corpus(spark, sf)).select(
        "ID", "CATEGORY", "LABEL", "LABEL_BINARY"
    )


@query(
    "token_scores",
    S.with_(*SCORED)
    + "SELECT ID, pos::INTEGER AS pos, prev, token, round(prob, 12) AS prob, round(log_like, 6) AS log_like FROM scores",
)
def token_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).select(
        "ID", "pos", "prev", "token", F.round("prob", 12).alias("prob"),
        F.round("log_like", 6).alias("log_like"),
    )


@query(
    "token_data",
    S.with_(*TOKENS)
    + """SELECT ID, len(toks)::INTEGER AS n_scored, array_to_string(toks, ' ') AS token_text,
  round(list_sum(probs), 9) AS sum_prob, round(list_sum(lls), 6) AS sum_log_like,
  round(probs[1], 12) AS first_prob, round(lls[len(lls)], 6) AS last_log_like FROM td""",
)
def token_data_query(spark: SparkSession, sf: str) -> DataFrame:
    return token_data(spark, sf).select(
        "ID",
        F.size("decoded_tokens").alias("n_scored"),
        F.array_join("decoded_tokens", " ").alias("token_text"),
        F.round(A.array_sum(F.col("token_probs")), 9).alias("sum_prob"),
        F.round(A.array_sum(F.col("token_log_likes")), 6).alias("sum_log_like"),
        F.round(F.element_at("token_probs", 1), 12).alias("first_prob"),
        F.round(F.element_at("token_log_likes", -1), 6).alias("last_log_like"),
    )


@query(
    "top_next_token",
    S.with_(
        S.DOCS,
        """pairs AS (SELECT prev, token, count(*) AS c FROM (
  SELECT tokens[i] AS prev, tokens[i + 1] AS token FROM (
    SELECT tokens, unnest(range(1, len(tokens))) AS i FROM docs)) GROUP BY prev, token)""",
    )
    + """SELECT prev, token AS next_token, c AS n_seen, round(c::DOUBLE / total, 9) AS prob FROM (
  SELECT *, sum(c) OVER (PARTITION BY prev) AS total,
    row_number() OVER (PARTITION BY prev ORDER BY c DESC, token) AS r FROM pairs) WHERE r = 1""",
)
def top_next_token(spark: SparkSession, sf: str) -> DataFrame:
    return C.top_next(T.corpus(spark, sf)).withColumn("prob", F.round("prob", 9))


@query(
    "start_points_even",
    S.with_(S.DOCS, S.ITEMS)
    + f"SELECT ID, L::INTEGER AS n_tokens, array_to_string({S.even('L', NGRAM, STARTS, OFFSET)}, ',') AS points FROM items",
)
def start_points_even(spark: SparkSession, sf: str) -> DataFrame:
    points = A.start_points_even(F.size("tokens"), NGRAM, STARTS, OFFSET)
    return T.items(spark, sf).select(
        "ID", F.size("tokens").alias("n_tokens"), F.array_join(points, ",").alias("points")
    )


@query(
    "start_points_random",
    S.with_(S.ITEMS)
    + f"""SELECT ID, string_agg(p::VARCHAR, ',' ORDER BY h) AS points FROM (
  SELECT ID, p, md5('42|' || ID || '|' || p) AS h, row_number() OVER (PARTITION BY ID ORDER BY md5('42|' || ID || '|' || p)) AS r
  FROM (SELECT ID, unnest(range(CASE WHEN L <= {NGRAM} + {OFFSET} THEN greatest(1, least({OFFSET}, L // 3)) ELSE {OFFSET} END, L - {NGRAM})) AS p
    FROM items)) WHERE r <= {STARTS} GROUP BY ID""",
)
def start_points_random(spark: SparkSession, sf: str) -> DataFrame:
    points = A.start_points_random(
        F.size("tokens"), NGRAM, STARTS, OFFSET, 42, F.col("ID")
    )
    return (
        T.items(spark, sf)
        .select("ID", points.alias("p"))
        .where("p is not null")
        .select("ID", F.array_join("p", ",").alias("points"))
    )


@query(
    "target_ngrams",
    S.with_(S.ITEMS, S.starts_table(NGRAM, STARTS, OFFSET, CONTEXT))
    + f"SELECT ID, slot::INTEGER AS slot, start::INTEGER AS start, array_to_string(tokens[start + 1:start + {NGRAM}], ' ') AS target FROM st",
)
def target_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    points = A.start_points_even(F.size("tokens"), NGRAM, STARTS, OFFSET)
    items = T.items(spark, sf).withColumn("points", points)
    return items.select(
        "ID", "points",
        F.posexplode(A.target_ngrams(F.col("tokens"), F.col("points"), NGRAM)).alias("slot", "t"),
    ).select(
        "ID", "slot", F.expr("points[slot]").alias("start"), F.array_join("t", " ").alias("target")
    )


@query(
    "ngram_predictions",
    S.with_(*PREDICTED)
    + """SELECT ID, slot::INTEGER AS slot, start::INTEGER AS start, context, array_to_string(target, ' ') AS target,
  coalesce(array_to_string(greedy, ' '), '') AS predicted FROM at_start LEFT JOIN greedy USING (context)""",
)
def ngram_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_rows(spark, sf).select(
        "ID", "slot", "start", "context", F.array_join("target", " ").alias("target"),
        F.array_join("greedy", " ").alias("predicted"),
    )


@query(
    "cdd_generation",
    S.with_(*GENERATED)
    + """SELECT ID, array_to_string(any_value(greedy), ' ') AS greedy_text, count(sample_no)::INTEGER AS n_samples,
  coalesce(string_agg(array_to_string(sample, ' '), ' / ' ORDER BY sample_no), '') AS sample_text,
  greatest(len(any_value(greedy)), coalesce(max(len(sample)), 0))::INTEGER AS max_length FROM gen GROUP BY ID""",
)
def cdd_generation(spark: SparkSession, sf: str) -> DataFrame:
    return generations(spark, sf).select(
        "ID",
        F.array_join("GREEDY_IDS", " ").alias("greedy_text"),
        F.size("SAMPLE_IDS").alias("n_samples"),
        F.array_join(F.transform("SAMPLE_IDS", lambda s: F.array_join(s, " ")), " / ").alias(
            "sample_text"
        ),
        F.col("MAX_LENGTH").alias("max_length"),
    )


def _end_word(spark: SparkSession, sf: str) -> str:
    """The most common corpus word, ties to the smallest: stands in for the end token."""
    best = C.ngram_counts(T.corpus(spark, sf), 1).agg(
        F.min(F.struct((-F.col("n_seen")).alias("less"), "gram"))["gram"]
    )
    return best.first()[0]


_CUT = """endw AS (SELECT w FROM (SELECT unnest(tokens) AS w FROM docs) GROUP BY w ORDER BY count(*) DESC, w LIMIT 1),
cut AS (SELECT doc_id, lang, tokens, CASE WHEN list_position(tokens, w) > 0 THEN tokens[1:list_position(tokens, w)] ELSE tokens END AS kept
  FROM docs JOIN documents USING (doc_id) CROSS JOIN endw)"""


def _truncated(spark: SparkSession, sf: str) -> DataFrame:
    end = F.lit(_end_word(spark, sf))
    docs = T.spread(T.table(spark, sf, "documents"), "doc_id").select(
        "doc_id", "lang", A.words(F.col("text")).alias("tokens")
    )
    return docs.withColumn("kept", A.truncate_ids(F.col("tokens"), end))


@query(
    "truncate_ids",
    S.with_(S.DOCS, _CUT)
    + "SELECT doc_id, len(tokens)::INTEGER AS n_before, len(kept)::INTEGER AS n_after, kept[len(kept)] AS last_token FROM cut",
)
def truncate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _truncated(spark, sf).select(
        "doc_id", F.size("tokens").alias("n_before"), F.size("kept").alias("n_after"),
        F.try_element_at("kept", F.lit(-1)).alias("last_token"),
    )


@query(
    "truncation_report",
    S.with_(S.DOCS, _CUT)
    + "SELECT lang, round(avg(len(tokens)), 6) AS mean_before, round(avg(len(kept)), 6) AS mean_after FROM cut GROUP BY lang",
)
def truncation_report(spark: SparkSession, sf: str) -> DataFrame:
    from leakscope.operators.metrics import length_report

    return length_report(_truncated(spark, sf), "tokens", "kept", ["lang"]).select(
        "lang", F.round("mean_before", 6).alias("mean_before"),
        F.round("mean_after", 6).alias("mean_after"),
    )
