"""Raw documents to packed training sequences, in five stages.

Each stage takes all rows that its predecessor kept, and all but the last return the
columns of documents.  What a stage returns is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.llm.exact_dedup import exact_dedup
from leakscope.llm.near_dedup import near_dedup
from leakscope.llm.packing import pack_documents
from leakscope.llm.quality_cnn import quality_network, with_quality
from leakscope.llm.queries import TOKENIZER, held_out
from leakscope.llm.rows import attach, free_name
from leakscope.llm.shelf import Shelf
from leakscope.llm.substring_dedup import substring_dedup

# The fit and the neighbours of each document decide, which SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores at one half or more.

    Null, empty and very long texts are scored whole like any other; repeated rows share
    their score, and a score of exactly one half stays.  Columns of ``docs`` are returned as they
    are, whatever their names.  An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(3, 1))
    net = quality_network(docs, labels)
    score = free_name(docs, "llm_score")
    return with_quality(docs, net, score).where(F.col(score) >= 0.5).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with the largest doc_id.

    A null text equals an empty one.  A null doc_id stays only where its text has no other;
    of rows alike in doc_id and text one stays.  Other columns come along, whatever their names.
    An empty table stays empty.
    """
    return _without(docs, exact_dedup(docs), "exact")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that with the smallest doc_id.

    Texts are linked from 80 percent of common five-word shingles on.  Texts without words,
    null ones too, stand alone and stay.  A component without any doc_id keeps one row;
    of rows alike in doc_id and text one stays.  Other columns come along, whatever their names.
    An empty table stays empty.
    """
    return _without(docs, near_dedup(docs, percent=80), "near")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier; other texts stay as they are.

    A text that loses words is its kept words joined by one space, and may be empty; its n_chars
    follows.  Null texts stay null.  All rows stay: of rows alike in doc_id and text the first
    keeps its passages.  Very long texts are cut like others.  Other columns come along,
    whatever their names.  An empty table stays empty.
    """
    found = substring_dedup(docs, texts=True).where("n_removed > 0")
    names = docs.columns
    text = free_name(docs, "llm_text")
    cut = attach(docs, found, {"kept_text": text}, Shelf(spark, "cut"))
    changed = F.col(text).isNotNull()
    new = {
        "text": F.when(changed, F.col(text)).otherwise(F.col("text")),
        "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars")),
    }
    return cut.withColumns(new).select(*[f"`{c}`" for c in names])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 ids.

    A null text counts as empty and gives one piece, its end id; a very long one gives many.
    Repeated rows are packed as often as they occur, in any order among themselves.  Other columns
    are ignored.  An empty table gives no pieces.
    """
    return pack_documents(docs, TOKENIZER, end_id=1, length=2048)


def _without(docs: DataFrame, verdict: DataFrame, name: str) -> DataFrame:
    kept = free_name(docs, "llm_kept")
    rows = attach(docs, verdict, {"kept": kept}, Shelf(docs.sparkSession, name))
    return rows.where(F.col(kept)).drop(kept)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("substring dedup", substrings),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    shelf = Shelf(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shelf.put(docs, f"stage{k}")
    return docs
