"""Readers for detector inputs: declared schemas, model id from the path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import schemas


def _path() -> Column:
    return F.col("_metadata.file_path")


def folder(depth: int) -> Column:
    """Name of the directory ``depth`` levels above the file."""
    return F.try_element_at(F.split(_path(), "/"), F.lit(-1 - depth))


def read_items(spark: SparkSession, path: str, verbose: bool = False) -> DataFrame:
    """Labelled items from parquet, or from JSON when the path says so."""
    schema = schemas.VERBOSE_ITEM if verbose else schemas.ITEM
    reader = spark.read.schema(schema)
    if str(path).endswith((".json", ".jsonl")):
        return reader.json(path, multiLine=str(path).endswith(".json"))
    return reader.parquet(path)


def _stage(spark: SparkSession, path: str | Sequence[str], schema: str, depth: int) -> DataFrame:
    """One JSON array file per model; files are read in parallel, never merged first."""
    frame = spark.read.schema(schema).option("recursiveFileLookup", "true").json(
        path, multiLine=True
    )
    return frame.withColumn("model_id", folder(depth))


def read_token_data(spark: SparkSession, path: str | Sequence[str], depth: int = 1) -> DataFrame:
    return _stage(spark, path, schemas.TOKEN_DATA, depth)


def read_cdd(spark: SparkSession, path: str | Sequence[str], depth: int = 1) -> DataFrame:
    """Generations; sample size, maximum length and seed come from the file name."""
    frame = _stage(spark, path, schemas.CDD_GENERATION, depth)
    name = F.col("_metadata.file_name")

    def number(key: str) -> Column:
        return F.regexp_extract(name, rf"{key}[_-]?(\d+)", 1).try_cast("int")

    return frame.withColumns(
        {"sample_size": number("samples?"), "max_new_tokens": number("max"), "gen_seed": number("seed")}
    )


def _int_keys(df: DataFrame, column: str) -> DataFrame:
    """JSON object keys back to integers."""
    return df.withColumn(column, F.transform_keys(column, lambda k, v: k.cast("int")))


def read_ngram(spark: SparkSession, path: str | Sequence[str], depth: int = 1) -> DataFrame:
    return _int_keys(_stage(spark, path, schemas.NGRAM_GENERATION, depth), "NGRAM_GENERATION_DATA")


def read_ngram_ll(spark: SparkSession, path: str | Sequence[str], depth: int = 1) -> DataFrame:
    return _int_keys(
        _stage(spark, path, schemas.NGRAM_LOGLIKE_GENERATION, depth), "NGRAM_LOGLIKE_GENERATION_DATA"
    )


def read_ngram_cdd(spark: SparkSession, path: str | Sequence[str], depth: int = 1) -> DataFrame:
    return _int_keys(
        _stage(spark, path, schemas.NGRAM_CDD_GENERATION, depth), "NGRAM_CDD_GENERATION_DATA"
    )


def truncate_nested(df: DataFrame, end: int, column: str = "NGRAM_CDD_GENERATION_DATA") -> DataFrame:
    """Cut the samples two map levels down after their first end token."""
    cut = (
        f"transform_values({column}, (k, v) -> named_struct('starttoken', v.starttoken, "
        "'cdd_generation_data', transform(v.cdd_generation_data, g -> named_struct("
        "'GREEDY_IDS', g.GREEDY_IDS, 'SAMPLE_IDS', transform(g.SAMPLE_IDS, s -> "
        f"if(array_position(s, {end}) > 0, slice(s, 1, cast(array_position(s, {end}) as int)), s)), "
        "'MAX_LENGTH', g.MAX_LENGTH))))"
    )
    return df.withColumn(column, F.expr(cut))


def ngram_cdd_long(df: DataFrame, column: str = "NGRAM_CDD_GENERATION_DATA") -> DataFrame:
    """The nested map as rows: one per item, n and start point."""
    keys = [c for c in df.columns if c != column]
    per_n = df.select(*keys, F.explode(column).alias("n", "v"))
    return per_n.select(
        *keys, "n", "v.starttoken", F.posexplode("v.cdd_generation_data").alias("slot", "g")
    ).select(
        *keys, "n", "slot", F.expr("get(starttoken, slot)").alias("start"), "g.*"
    )


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.METHOD_LINE) -> DataFrame:
    """Line logs; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_correctness(spark: SparkSession, root: str) -> DataFrame:
    """Score tables in ``MODEL_SHORT=<name>/`` folders; the folder becomes the column."""
    plain = schemas.CORRECTNESS.replace(", MODEL_SHORT string", "")
    return (
        spark.read.schema(f"{plain}, MODEL_SHORT string")
        .option("basePath", root)
        .csv(root, header=True)
        .na.drop(subset=["ID"])
    )


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Run outputs {metadata, data[]} as one row per answer."""
    runs = spark.read.schema(schemas.ANSWER_FILE).json(path, multiLine=True)
    return runs.select("metadata", F.inline("data"))
