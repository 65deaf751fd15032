"""Stage tables: compute once, load afterwards."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def materialize(
    spark: SparkSession,
    base: str,
    name: str,
    key: Mapping[str, str],
    build: Callable[[], DataFrame],
    force: bool = False,
) -> DataFrame:
    """Stage ``name`` for one key (model, parameters) as a partition of its table.

    A key already present is read back unless ``force``; a rebuild replaces
    that key's partition and leaves the others alone.
    """
    path = f"{base}/{name}"

    def load() -> DataFrame:
        frame = spark.read.parquet(path)
        for column, value in key.items():
            frame = frame.where(F.col(column) == value)
        return frame

    if not force:
        try:
            ready = load()
            if ready.limit(1).count():
                return ready
        except AnalysisException:
            pass
    tagged = build().withColumns({c: F.lit(v) for c, v in key.items()})
    (
        tagged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*key)
        .parquet(path)
    )
    return load()
