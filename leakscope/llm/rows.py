"""Per-row results of an operator brought back to the rows they belong to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.shelf import Shelf


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def attach(docs: DataFrame, results: DataFrame, columns: Mapping[str, str], shelf: Shelf) -> DataFrame:
    """``docs`` with columns of ``results`` under the given names; null where it has no row.

    ``results`` has doc_id and source_key (a hash of doc_id and text) of the row it speaks
    of.  Rows that repeat both are alike: each takes one of their results.  ``docs`` must not
    have a column of the given names (see ``free_name``); its other columns may have any name.
    """
    ident, key, own, copy, number = (
        free_name(docs, f"attach_{c}") for c in ("id", "key", "own", "copy", "number")
    )
    named = shelf.put(
        results.select(
            F.col("doc_id").alias(ident),
            F.col("source_key").alias(key),
            *[F.col(c).alias(name) for c, name in columns.items()],
        ),
        "results",
    )
    left = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    on = (F.col(own) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(ident))
    twins = named.groupBy(key, ident).count().where("count > 1")
    if not twins.isEmpty():
        left = left.withColumn(
            copy, F.row_number().over(Window.partitionBy(own, "doc_id").orderBy(own))
        )
        order = list(columns.values())
        named = named.withColumn(
            number, F.row_number().over(Window.partitionBy(key, ident).orderBy(*order))
        )
        on = on & (F.col(copy) == F.col(number))
    return left.join(named, on, "left").select(
        *[f"`{c}`" for c in docs.columns], *columns.values()
    )
