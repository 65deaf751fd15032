"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from leakscope.llm.exact_dedup import exact_dedup
from leakscope.llm.merges import encode_merges
from leakscope.llm.merkle import fold, merkle_manifest, proof_digest
from leakscope.llm.near_dedup import near_dedup
from leakscope.llm.packing import pack_documents
from leakscope.llm.pieces import check_pieces
from leakscope.llm.quality_cnn import quality_network, score_quality
from leakscope.llm.quality_rules import quality_rules
from leakscope.llm.registry import ORACLES, QUERIES, documents, query
from leakscope.llm.sharding import shard_documents
from leakscope.llm.simhash import simhash_dedup
from leakscope.llm.sql import near_sql, rules_sql, substring_sql
from leakscope.llm.substring_dedup import substring_dedup
from leakscope.llm.token_files import token_files
from leakscope.llm.toxicity import score_toxicity, toxicity_model
from leakscope.llm.whitening import whiten

__all__ = ["ORACLES", "QUERIES"]

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def held_out(folds: int, fold: int):
    """Rows whose labels are not learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold


def scored(df, is_out):
    return df.select(
        "doc_id",
        is_out.alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op1_ring_shards")
def _(spark, sf_dir):
    rows = shard_documents(documents(spark, sf_dir), shards=8)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_quality_rules", rules_sql())
def _(spark, sf_dir):
    return quality_rules(documents(spark, sf_dir))


@query(
    "op7_exact_dedup",
    """
    SELECT doc_id,
           max(doc_id) OVER g AS keep_id,
           count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
)
def _(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir)).drop("source_key")


@query("op2_near_dedup", near_sql(85))
def _(spark, sf_dir):
    return near_dedup(documents(spark, sf_dir), percent=85).drop("source_key")


@query("op9_substring_dedup", substring_sql(20))
def _(spark, sf_dir):
    return substring_dedup(documents(spark, sf_dir))


@query("op3_quality_cnn")
def _(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = quality_network(docs, labels.where(~held_out(3, 1)))
    return scored(score_quality(docs, net), held_out(3, 1))


@query("op10_toxicity")
def _(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity_model(docs, labels.where(~held_out(5, 0)))
    return scored(score_toxicity(docs, model), held_out(5, 0))


@query("op6_token_files")
def _(spark, sf_dir):
    return token_files(documents(spark, sf_dir), TOKENIZER, end_id=2)


@query("op8_packing")
def _(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir), TOKENIZER, end_id=1, length=2048)


@query("op4_piece_scan")
def _(spark, sf_dir):
    return check_pieces(encode_merges(documents(spark, sf_dir), PIECES), PIECES)


MANIFEST_SQL = """
    WITH RECURSIVE
    bytes AS (
        SELECT doc_id, source, text, lang, n_chars,
               list_reduce([4294967295] || flatten(list_transform(
                   string_split(doc_id::VARCHAR, ''),
                   lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                   lambda c, o: CASE WHEN o >= 0 THEN xor(c, o)
                                     WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
                                     ELSE c >> 1 END) & 1 = 1 AS tampered
        FROM documents
    ),
    texts AS (
        SELECT *, unnest([false, true]) AS changed FROM bytes
    ),
    hashed AS (
        SELECT doc_id, source, changed, sha256(
            list_aggregate(list_transform(
                [doc_id::VARCHAR, source, lang, n_chars::VARCHAR,
                 CASE WHEN changed AND tampered THEN replace(text, chr(10), '') ELSE text END],
                lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')), 'string_agg', '')) AS leaf
        FROM texts
    ),
    leaves AS (
        SELECT a.doc_id, a.source, a.leaf, b.leaf AS changed_leaf
        FROM hashed a JOIN hashed b ON a.doc_id = b.doc_id AND NOT a.changed AND b.changed
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
               count(*) OVER (PARTITION BY source) AS n,
               dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree
        FROM leaves
    ),
    nodes(tree, level, pos, n, digest) AS (
        SELECT tree, 0, pos, n, leaf FROM ranked
        UNION ALL
        SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
        FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 3, n
    ),
    subroots AS (SELECT tree, digest FROM nodes WHERE n = 1),
    upper_nodes(level, pos, n, digest) AS (
        SELECT 0, tree - 1, (SELECT count(*) FROM subroots), digest FROM subroots
        UNION ALL
        SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
        FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 3, n
    ),
    runs AS (
        SELECT r.doc_id, k.level,
               coalesce(string_agg(k.digest, '' ORDER BY k.pos)
                   FILTER (k.pos < r.pos // (3 ** k.level)::BIGINT), '') AS l,
               coalesce(string_agg(k.digest, '' ORDER BY k.pos)
                   FILTER (k.pos > r.pos // (3 ** k.level)::BIGINT), '') AS r
        FROM ranked r JOIN nodes k
          ON k.tree = r.tree AND k.n > 1 AND k.pos // 3 = r.pos // (3 ** (k.level + 1))::BIGINT
        GROUP BY r.doc_id, k.level
        UNION ALL
        SELECT r.doc_id, 100 + k.level,
               coalesce(string_agg(k.digest, '' ORDER BY k.pos)
                   FILTER (k.pos < (r.tree - 1) // (3 ** k.level)::BIGINT), ''),
               coalesce(string_agg(k.digest, '' ORDER BY k.pos)
                   FILTER (k.pos > (r.tree - 1) // (3 ** k.level)::BIGINT), '')
        FROM ranked r JOIN upper_nodes k
          ON k.n > 1 AND k.pos // 3 = (r.tree - 1) // (3 ** (k.level + 1))::BIGINT
        GROUP BY r.doc_id, k.level
    ),
    paths AS (
        SELECT doc_id, string_agg(l || r, '' ORDER BY level) AS siblings,
               list(l || '|' || r ORDER BY level) AS steps
        FROM runs GROUP BY doc_id
    ),
    folded AS (
        SELECT r.doc_id, r.leaf, s.digest AS subroot, (SELECT digest FROM upper_nodes WHERE n = 1) AS root,
               sha256(coalesce(p.siblings, '')) AS proof_sha256,
               list_reduce([r.changed_leaf] || coalesce(p.steps, []),
                   lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2)))
                   AS folded_root
        FROM ranked r JOIN subroots s ON s.tree = r.tree LEFT JOIN paths p ON p.doc_id = r.doc_id
    )
    SELECT *, folded_root = root AS verified FROM folded
"""


@query("op11_interval_manifest", MANIFEST_SQL)
def _(spark, sf_dir):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle_manifest(documents(spark, sf_dir), tampered)
    folded = fold(F.col("changed_leaf"), F.col("path"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_simhash_dedup")
def _(spark, sf_dir):
    found = simhash_dedup(documents(spark, sf_dir), words=3, distance=2)
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


@query("op13_whitening")
def _(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    edge = F.lit(2.0**62)  # no long holds more; entries of embeddings are nowhere near
    scaled = lambda c: F.floor(F.greatest(F.least(c * 1024, edge), -edge))
    found = whiten(vectors, lambda c: scaled(c) + 100_000, components=8)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("k", "own")
    return found.select("id", "n", "deviation", "identity_error", each).select(
        F.col("id").alias("vec_id"),
        (F.col("k") + 1).alias("component"),
        "n",
        "deviation",
        "own.whitened",
        "own.explained",
        "identity_error",
    )
