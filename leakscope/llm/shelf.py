"""Tables written once into the shared folder and read back, to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leakscope.session import ensure_checkpoint_dir


class Shelf:
    """Parquet tables of one operator run, in a folder of their own.

    The folder lies under the checkpoint folder of the session, which every
    executor sees; a lost executor loses none of it.  ``drop`` removes a table
    that no later plan reads.  What a returned DataFrame still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext.getCheckpointDir()
        self.spark = spark
        self.root = f"{base}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.options(**{"compression": "zstd", **options}).parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
