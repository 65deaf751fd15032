"""Detector inputs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope.functions.arrays import words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Fill all cores when a small input arrives in fewer splits than there are cores.

    Large inputs have more splits than cores and are left alone, so no text is
    shuffled there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as word arrays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spread(docs, "doc_id").select("doc_id", words(F.col("text")).alias("tokens"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts cut into problem (first half of the words) and solution."""
    tokens = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("ID"), words(F.col("text")).alias("tokens")
    )
    return tokens.selectExpr(
        "ID",
        "case when size(tokens) < 30 then 'short' when size(tokens) < 45 then 'medium' "
        "else 'long' end as CATEGORY",
        "array_join(slice(tokens, 1, size(tokens) div 2), ' ') as PROBLEM",
        "array_join(slice(tokens, size(tokens) div 2 + 1, size(tokens)), ' ') as SOLUTION",
        "tokens",
        "size(tokens) div 2 as problem_length",
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with surface features: the larger threshold fixture."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id").join(
        table(spark, sf_dir, "labels"), "doc_id"
    )
    return docs.select(
        F.col("doc_id").cast("string").alias("ID"),
        F.col("lang").alias("CATEGORY"),
        F.col("source").alias("SOURCE"),
        F.when(F.col("quality") == 1, "Conta").otherwise("Clean").alias("LABEL"),
        F.col("quality").alias("LABEL_BINARY"),
        words(F.col("text")).alias("tokens"),
        F.split("text", "\n").alias("lines"),
        "text",
        "n_chars",
    ).selectExpr(
        "ID",
        "CATEGORY",
        "SOURCE",
        "LABEL",
        "LABEL_BINARY",
        "size(tokens) as n_words",
        "try_divide(cast(size(array_distinct(tokens)) as double), size(tokens)) as distinct_share",
        "try_divide(cast(n_chars as double), size(tokens)) as chars_per_word",
        "1 - try_divide(cast(size(array_distinct(lines)) as double), size(lines)) as line_repeat",
        "try_divide(cast(length(regexp_replace(text, '[^0-9]', '')) as double), n_chars) as digit_share",
        "n_chars",
    )


def correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded answers: one row per labelled document, its source standing in for the model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").cast("string").alias("ID"),
        F.col("lang").alias("CATEGORY"),
        F.when(F.col("toxic") == 1, "Conta").otherwise("Clean").alias("LABEL"),
        F.col("quality").alias("CORRECTNESS"),
        F.col("source").alias("MODEL_SHORT"),
    )


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per user turn, with the assistant turn right after it as its SOLUTION.

    A user turn without an answer has a null SOLUTION. Both sides meet on
    (conv_id, turn), so a long conversation spreads like any other rows.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").selectExpr("conv_id", "turn", "text as PROBLEM")
    said = turns.where("role = 'assistant'").selectExpr("conv_id", "turn - 1 as turn", "text as SOLUTION")
    return asked.join(said, ["conv_id", "turn"], "left")
