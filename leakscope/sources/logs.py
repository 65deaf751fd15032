"""Result logs: discovery, strict reading, and the sinks that write them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakscope import schemas


def find_logs(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Matching files below ``root`` as rows (file_path, file_name, value)."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(root, wholetext=True)
    )
    return files.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        "value",
    )


def _documents(text: str, split: bool) -> list[str]:
    """JSON documents of one file; none when it is broken and ``split`` is off."""
    decoder, found, at = json.JSONDecoder(), [], 0
    text = text.strip()
    while at < len(text):
        try:
            _, end = decoder.raw_decode(text, at)
        except ValueError:
            return found if split else []
        found.append(text[at:end])
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return found if split or len(found) == 1 else []


def read_documents(files: DataFrame, on_corrupt: str = "skip") -> DataFrame:
    """Well-formed JSON documents of the files.

    Spark's own parsers accept two documents back to back and keep the first.
    Here such a file is skipped, or split into its documents.
    """
    if on_corrupt not in ("skip", "split"):
        raise ValueError("on_corrupt must be 'skip' or 'split'")
    split = on_corrupt == "split"

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (r.file_path, r.file_name, i, doc)
                for r in pdf.itertuples(index=False)
                for i, doc in enumerate(_documents(r.value, split))
            ]
            yield pd.DataFrame(rows, columns=["file_path", "file_name", "doc_no", "value"])

    return files.mapInPandas(check, "file_path string, file_name string, doc_no int, value string")


def _parsed(spark: SparkSession, root: str, glob: str, schema: str, on_corrupt: str) -> DataFrame:
    docs = read_documents(find_logs(spark, root, glob), on_corrupt)
    return docs.select(
        "file_path", "file_name", "doc_no", F.from_json("value", schema).alias("log")
    ).select("file_path", "file_name", "doc_no", "log.*")


def read_test_logs(
    spark: SparkSession, root: str, glob: str, on_corrupt: str = "skip"
) -> DataFrame:
    return _parsed(spark, root, glob, schemas.TEST_LOG, on_corrupt)


def read_train_logs(
    spark: SparkSession, root: str, glob: str, on_corrupt: str = "skip"
) -> DataFrame:
    return _parsed(spark, root, glob, schemas.TRAIN_LOG, on_corrupt)


def merge_files(spark: SparkSession, paths: list[str], out: str, schema: str) -> None:
    """JSON array files to one data set."""
    spark.read.schema(schema).json(paths, multiLine=True).write.mode("overwrite").json(out)


def write_log(df: DataFrame, base: str) -> None:
    """Append run records as JSON lines below folders of their model and method.

    The folders come from copies, so every record keeps both fields as they are.
    """
    keep = df.withColumn("model", F.regexp_replace("model_id", "/", "__")).withColumn(
        "method", F.col("method_name")
    )
    keep.write.mode("append").partitionBy("model", "method").json(base)


def write_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if fmt == "csv" else writer.parquet(path)


def write_answers(df: DataFrame, metadata, path: str, batch: int) -> None:
    """Run outputs {metadata, data[]} of ``batch`` answers each, named by row range.

    ``df`` carries ``row_idx``, the explicit answer order. Batches are grouped
    by row range, so each holds at most ``batch`` rows.
    """
    fields = [c for c in df.columns if c != "row_idx"]
    first = (F.floor(F.col("row_idx") / batch) * batch).cast("bigint")
    grouped = df.groupBy(first.alias("first")).agg(
        F.array_sort(F.collect_list(F.struct("row_idx", *fields))).alias("d"),
        F.max("row_idx").alias("last"),
    )
    shaped = grouped.select(
        F.concat_ws("-", "first", "last").alias("rows"),
        metadata.alias("metadata"),
        F.transform("d", lambda r: F.struct(*[r[c].alias(c) for c in fields])).alias("data"),
    )
    shaped.write.mode("append").partitionBy("rows").json(path)
