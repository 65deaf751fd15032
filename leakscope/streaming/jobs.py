"""Incremental scoring, metrics and answer output."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leakscope import schemas
from leakscope.functions import arrays as A


def slope_of_scores(scores: Column) -> Column:
    """Slope of the normalised cumulative curve straight from the scores.

    Row-local: the score at j counts once for every later position, so
    sum x (C_x - C_0) = sum_j ll_j (sum of x from j to the end).
    """
    m = F.size(scores).cast("double")
    weighted = F.aggregate(
        F.transform(scores, lambda v, j: v * ((m - 1) * m - (j - 1) * j) / 2 * F.when(j > 0, 1.0).otherwise(0.0)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )
    return F.try_divide(F.try_divide(weighted, m), (m - 1) * m * (2 * m - 1) / 6)


def detectors(k: float = 20.0, n: int = 3, starts: int = 10, offset: int = 5) -> Mapping[str, Column]:
    """Features that need one row only, so they run on a stream without state."""
    ll = F.col("token_log_likes")
    points = A.start_points_even(F.size(ll), n, starts, offset)
    return {
        "minK": A.mink(F.col("token_probs"), F.lit(k)),
        "ngram_loglike": A.array_mean(A.ngram_loglike(ll, points, n)),
        "curve_slope": slope_of_scores(ll),
    }


def score(df: DataFrame, detector: str, theta: float, **options) -> DataFrame:
    """Feature and decision per row; works on batch and streaming input alike.

    A slope fires at its threshold, the other features above it.
    """
    feature = F.col("feature")
    fires = feature >= theta if detector == "curve_slope" else feature > theta
    return df.withColumn("feature", detectors(**options)[detector]).withColumn(
        "PREDICTION_BINARY", F.coalesce(fires, F.lit(False)).cast("int")
    ).select(*[c for c in df.columns if c == "model_id"], "ID", "CATEGORY", "LABEL_BINARY", "feature", "PREDICTION_BINARY")


def stream_score(
    spark: SparkSession, in_dir: str, out_dir: str, state_dir: str, detector: str, theta: float,
    **options,
) -> StreamingQuery:
    """Score token files that arrived since the last run and append the rows."""
    incoming = spark.readStream.schema("model_id string, " + schemas.TOKEN_DATA).json(in_dir, multiLine=True)
    return (
        score(incoming, detector, theta, **options)
        .writeStream.format("parquet")
        .option("checkpointLocation", state_dir)
        .option("path", out_dir)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def answer_counts(df: DataFrame) -> DataFrame:
    """Hits and totals per model and method of a line log."""
    hit = F.col("output") == F.col("label").isin("1", "true", "True")
    return df.groupBy("model_id", "method_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct")
    )


def stream_metrics(
    spark: SparkSession, in_dir: str, state_dir: str, sink: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Running accuracy per model and method; state is one row per pair."""
    lines = spark.readStream.schema(schemas.METHOD_LINE).json(in_dir)
    return (
        answer_counts(lines)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", state_dir)
        .foreachBatch(sink)
        .trigger(availableNow=True)
        .start()
    )


def line_events(lines: DataFrame, file_time: Column) -> DataFrame:
    """Lines of a method log with event_time and line_key.

    Two lines with the same key are one event that was logged twice.  A line without a
    readable timestamp takes ``file_time``.
    """
    names = [c for c in lines.columns if c not in ("parameters", "output", "label")]
    settings = F.array_sort(F.map_entries("parameters"))
    return lines.select(
        "*",
        F.coalesce(F.try_to_timestamp("timestamp"), file_time).alias("event_time"),
        F.to_json(F.struct(*names, settings.alias("parameters"))).alias("line_key"),
    )


def stream_batch_metrics(
    spark: SparkSession, in_dir: str, out_dir: str, state_dir: str, lateness: str = "1 hour"
) -> StreamingQuery:
    """Hits and totals of the lines of each micro-batch, one row per model and method.

    A line logged twice counts once: its key stays in the state until the watermark has
    passed its time by ``lateness``, and whatever comes later than that is left out.  A
    batch that is replayed overwrites its own partition, so it changes nothing.
    """
    lines = spark.readStream.schema(schemas.METHOD_LINE).json(in_dir)
    events = line_events(lines, F.col("_metadata.file_modification_time"))

    def flush(batch: DataFrame, batch_id: int) -> None:
        (
            answer_counts(batch)
            .withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .parquet(out_dir)
        )

    return (
        events.withWatermark("event_time", lateness)
        .dropDuplicatesWithinWatermark(["line_key"])
        .writeStream.foreachBatch(flush)
        .option("checkpointLocation", state_dir)
        .trigger(availableNow=True)
        .start()
    )


def metrics_so_far(spark: SparkSession, out_dir: str) -> DataFrame:
    """Running accuracy per model and method from the written batches."""
    kind = "model_id string, method_name string, total long, correct long, batch_id int"
    counts = spark.read.schema(kind).parquet(out_dir)
    return counts.groupBy("model_id", "method_name").agg(
        F.sum("total").alias("total"),
        F.sum("correct").alias("correct"),
        F.try_divide(F.sum("correct"), F.sum("total")).alias("accuracy"),
        F.max("batch_id").alias("last_batch"),
    )


def stream_answers(
    answers: DataFrame, metadata: Column, out_dir: str, state_dir: str
) -> StreamingQuery:
    """Write each micro-batch of answers with the run metadata, once per batch id.

    Rows stay one per answer, so a batch of any size is written in parallel; a
    batch that is replayed overwrites its own partition only.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("metadata", metadata)
            .withColumn("batch_id", F.lit(batch_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch_id")
            .json(out_dir)
        )

    return (
        answers.writeStream.foreachBatch(flush)
        .option("checkpointLocation", state_dir)
        .trigger(availableNow=True)
        .start()
    )
