"""Sharding over a consistent-hash ring with bounded loads, in DataFrame operations.

A ring of 65,536 cells carries ``vnodes`` points of every shard.  A row hashes to
a cell and belongs to the next point clockwise.  Each shard takes its own rows up
to its capacity; rows beyond it go on clockwise to the next point whose shard has
room.  Without slack the capacities add up to the number of rows and differ by
at most one, so counts are equal; with slack fewer rows leave their own shard.

Only counts per point (vnodes x shards numbers, whatever the input) reach the
driver, where the ring is walked; rows are ranked within cells in parallel.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.shelf import Shelf

CELL_BITS = 16
VNODES = 64


def ring_points(df: DataFrame, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every point in clockwise order; a point's place is its own.

    A shard's points do not depend on how many other shards there are.
    """
    points = df.sparkSession.range(shards * vnodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.xxhash64(
            F.lit("point"), F.col("id") % shards, F.floor(F.col("id") / shards)
        ).alias("h"),
    )
    cell = F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int").alias("cell")
    return sorted((r.cell, r.shard) for r in points.select(cell, "shard").collect())


def capacities(total: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-int(-total * (1 + slack) // shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def deal(
    counts: list[int], owners: list[int], room: list[int]
) -> list[tuple[int, int, int, int, int]]:
    """(point, from rank, to rank, shard, first slot) so that no shard exceeds its room.

    Own rows come first; the rest goes on clockwise, nearest points first.
    """
    room = list(room)
    used = [0] * len(room)
    plan = []

    def take(point: int, lo: int, hi: int, shard: int) -> int:
        n = min(hi - lo, room[shard])
        if n:
            plan.append((point, lo, lo + n, shard, used[shard]))
            used[shard] += n
            room[shard] -= n
        return lo + n

    rest = [take(p, 0, n, owners[p]) for p, n in enumerate(counts)]
    for step in range(1, len(counts)):
        waiting = [p for p, n in enumerate(counts) if rest[p] < n]
        if not waiting:
            break
        for p in waiting:
            rest[p] = take(p, rest[p], counts[p], owners[(p + step) % len(counts)])
    return plan


def _table(df: DataFrame, rows: list[tuple], columns: str) -> DataFrame:
    """A table of a few rows known to the driver, as a literal."""
    names = [c.split()[0] for c in columns.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = "array<struct<" + ", ".join(c.replace(" ", ": ") for c in columns.split(", ")) + ">>"
    return df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), kind)))


def ring_shards(
    df: DataFrame, key: list[Column], shards: int, vnodes: int = VNODES, slack: float = 0.0
) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 within the shard) to every row of ``df``.

    ``key`` places a row on the ring; rows with equal keys are told apart by
    their other columns, and rows equal in all columns are interchangeable.  Null
    keys hash like a value of their own, so give a second key column that varies.
    ``df`` must not have columns that begin with ``ring_``.  Without rows the
    result is empty.
    """
    if shards < 1 or vnodes < 1 or slack < 0:
        raise ValueError("shards and vnodes must be positive, slack not negative")
    shelf = Shelf(df.sparkSession, "ring")
    order = list(df.columns)
    place = F.xxhash64(*key)
    rows = shelf.put(
        df.withColumn("ring_place", place).withColumn(
            "ring_cell", F.shiftrightunsigned("ring_place", 64 - CELL_BITS).cast("int")
        ),
        "rows",
    )
    points = ring_points(df, shards, vnodes)
    bounds, before = [], -1
    for p, (cell, _) in enumerate(points):
        if cell > before:  # a point that shares the cell of another gets no cells
            bounds.append((p, before + 1, cell))
            before = cell
    bounds.append((bounds[0][0], before + 1, (1 << CELL_BITS) - 1))
    arcs = (
        _table(df, [b for b in bounds if b[1] <= b[2]], "ring_point int, first int, last int")
        .withColumn("ring_cell", F.explode(F.sequence("first", "last")))
        .select("ring_cell", "ring_point")
    )
    along = Window.partitionBy("ring_point").orderBy("ring_cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cells = shelf.put(
        rows.groupBy("ring_cell")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(F.broadcast(arcs), "ring_cell")  # 65,536 rows at most
        .withColumn("ring_before", F.coalesce(F.sum("n").over(along), F.lit(0))),
        "cells",
    )
    counts = [0] * len(points)
    for r in cells.groupBy("ring_point").agg(F.sum("n").alias("n")).collect():
        counts[r.ring_point] = r.n
    plan = deal(counts, [s for _, s in points], capacities(sum(counts), shards, slack))
    parts = _table(
        df, plan, "ring_point int, ring_lo long, ring_hi long, shard int, ring_slot long"
    )
    inside = Window.partitionBy("ring_cell").orderBy("ring_place", *order)
    return (
        rows.join(cells.drop("n"), "ring_cell")
        .withColumn("ring_rank", F.col("ring_before") + F.row_number().over(inside) - 1)
        .join(F.broadcast(parts), "ring_point")  # a few rows a point at most
        .where("ring_rank >= ring_lo and ring_rank < ring_hi")
        .select(*order, "shard", (F.col("ring_slot") + F.col("ring_rank") - F.col("ring_lo")).alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 8, vnodes: int = VNODES, slack: float = 0.0):
    """Documents (doc_id, text) with shard and slot, their size and the crc of their text.

    Size is the UTF-8 length plus one; a null text counts as empty.  The ring key
    is (doc_id, text_crc32), so null or repeated ids spread by their texts.
    """
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    return ring_shards(rows, [F.col("doc_id"), F.col("text_crc32")], shards, vnodes, slack)
