"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.shelf import Shelf


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return row[0], row[1] or 0


def components(links: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(node, comp) for every node of the links (a, b); comp is the smallest node reached.

    Links may repeat and run either way.  Each step is a join against a table of
    minima, so a node with very many links is split like any skewed join side, and
    every step is written to the shared folder.  Steps grow with the logarithm of
    the longest chain.
    """
    edges = shelf.put(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        f"{name}-0",
    )
    before, step = _state(edges), 0
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = shelf.put(
            both.join(low, "u")
            .where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            f"{name}-{step}-large",
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), "m")
            .select("u", F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        step += 1
        fresh = shelf.put(small, f"{name}-{step}")
        after = _state(fresh)
        shelf.drop(f"{name}-{step - 1}-large", f"{name}-{step - 1}")
        edges = fresh
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
