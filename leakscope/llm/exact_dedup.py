"""Exact dedup over an extendible-hash index in shared files.

1. Every document gives an index entry (64-bit key, sha-256, id).  Entries of one
   key are counted with map-side combining.
2. The driver sees row counts of key prefixes only (65,536 at most) and builds the
   directory: it doubles while a bucket holds more keys than ``capacity``, and each
   overfull bucket is split by the next bit of the key.  Below a full prefix the
   directory keeps the depth alone, and the bits of the key name the bucket.
3. Documents whose key occurs once are unique.  The others are first collapsed
   within each input task (bytes compared), then go to the owner of their bucket,
   which walks its key range in order, chains the different texts of a key and
   compares bytes.  A link of a chain holds a text's best id, how many rows have that
   id, and its number of rows.  The chains are the index file of the bucket, in the
   shared folder.
4. Entries read their link back.  Only where the best id itself is on several rows,
   the first of these entries is looked up.

A hot text leaves each input task as one row, so its owner gets at most one row
of it a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.shelf import Shelf

PREFIX_BITS = 16
CAPACITY = 64
FLUSH_BYTES = 32 << 20


def directory(counts: dict[int, int], capacity: int, bits: int = PREFIX_BITS) -> dict[int, tuple[int, int]]:
    """prefix of ``bits`` bits -> (bucket's own prefix, local depth).

    Starts as one bucket of depth 0 and splits every bucket that holds more than
    ``capacity`` keys by its next bit.  Where a whole prefix holds more, it gets the
    depth at which evenly spread keys fit; its buckets lie below the own prefix.
    """
    found: dict[int, tuple[int, int]] = {}

    def split(prefix: int, depth: int, cells: list[tuple[int, int]]) -> None:
        load = sum(n for _, n in cells)
        if load <= capacity:
            found.update((cell, (prefix, depth)) for cell, _ in cells)
            return
        if depth == bits:
            below = (-(-load // capacity) - 1).bit_length()
            found.update((cell, (prefix, min(depth + below, 63))) for cell, _ in cells)
            return
        shift = bits - depth - 1
        for bit in (0, 1):
            split(
                prefix * 2 + bit, depth + 1, [x for x in cells if x[0] >> shift & 1 == bit]
            )

    split(0, 0, sorted(counts.items()))
    return found


def add(link: list, best: int | None, copies: int, rows: int) -> None:
    """Count rows of a text into its link [best, copies, rows]; a null id is the least."""
    link[2] += rows
    if best == link[0]:
        link[1] += copies
    elif link[0] is None or (best is not None and best > link[0]):
        link[0], link[1] = best, copies


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, body, best): one row for each different text, as far as FLUSH_BYTES reach."""
    seen: dict[bytes, tuple[int, list]] = {}
    held = 0

    def out() -> pa.RecordBatch:
        keys, links = zip(*seen.values(), strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                pa.array(list(seen), pa.binary()),
                *(pa.array(c, pa.int64()) for c in zip(*links, strict=True)),
            ],
            ["key", "body", "best", "copies", "rows"],
        )

    for batch in batches:
        for key, body, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if body in seen:
                add(seen[body][1], best, 1, 1)
                continue
            seen[body] = (key, [best, 1, 1])
            held += len(body)
            if held > FLUSH_BYTES:
                yield out()
                seen, held = {}, 0
    if seen:
        yield out()


CHAIN = "key long, text_sha256 string, chain long, best long, copies long, rows long"


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links in order of key: the different bodies of each key, numbered, with all their rows."""
    kind = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in CHAIN.split(", ")]
    last, links, done = None, {}, []

    def close() -> None:
        done.extend(
            (last, hashlib.sha256(body).hexdigest(), k, *link)
            for k, (body, link) in enumerate(links.items())
        )

    def out() -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[]] * len(kind)
        arrays = [pa.array(c, t) for c, t in zip(columns, kind, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        for key, body, best, copies, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                close()
                last, links = key, {}
            add(links.setdefault(body, [best, 0, 0]), best, copies, rows)
        yield out()
        done = []
    close()
    yield out()


def exact_dedup(
    docs: DataFrame, key: Column | None = None, capacity: int = CAPACITY, keep: str = "largest"
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, source_key) for every row of (doc_id, text).

    A null text counts as empty.  Of equal texts the largest (or smallest)
    doc_id stays; null ids stay only where a group has no other, and keep_id is
    null then.  Rows that repeat both id and text all count in group_size, and one
    of them is kept.  ``key`` replaces the 64-bit hash, for tests of collisions.
    Other columns are ignored; an empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession, "exact")
    text = F.coalesce("text", F.lit(""))
    hashed = F.xxhash64(text) if key is None else key.cast("long")
    entries = shelf.put(
        docs.select(
            "doc_id",
            F.xxhash64("doc_id", "text").alias("source_key"),
            hashed.alias("key"),
            F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "entries",
    )
    prefix = F.shiftrightunsigned("key", 64 - PREFIX_BITS).cast("int").alias("prefix")
    keys = shelf.put(
        entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", prefix),
        "keys",
    )
    counts = {r[0]: r[1] for r in keys.groupBy("prefix").count().collect()}
    slots = [(cell, d) for cell, (_, d) in directory(counts, capacity).items()]
    spark = docs.sparkSession
    table = shelf.put(spark.createDataFrame(slots, "prefix int, depth int").coalesce(1), "directory")
    order = F.col("doc_id") if keep == "largest" else F.bitwise_not("doc_id")
    same = docs.select(
        hashed.alias("key"), F.encode(text, "UTF-8").alias("body"), order.alias("best")
    ).join(keys.select("key"), "key", "left_semi")
    bucket = F.when(F.col("depth") == 0, 0).otherwise(F.expr("shiftrightunsigned(key, 64 - depth)"))
    chains = shelf.put(
        same.mapInArrow(collapse, "key long, body binary, best long, copies long, rows long")
        .withColumn("prefix", prefix)
        .join(F.broadcast(table), "prefix")
        .withColumn("bucket", bucket)
        .repartition("bucket", "depth")
        .sortWithinPartitions("key")
        .select("key", "body", "best", "copies", "rows")
        .mapInArrow(chain, CHAIN),
        "chains",
    )
    best = F.col("best") if keep == "largest" else F.bitwise_not("best")
    links = chains.select(
        "key", "text_sha256", best.alias("keep_id"), "copies", F.col("rows").alias("group_size")
    )
    by = ["key", "text_sha256"]
    repeated = links.where("copies > 1").select(*by, F.col("keep_id").alias("doc_id"))
    if repeated.isEmpty():
        result = links.withColumn("keep_row", F.lit(None).cast("long"))
    else:
        rows = entries.groupBy(*by, "doc_id").agg(F.min("row").alias("keep_row")).alias("e")
        same_id = F.col("e.doc_id").eqNullSafe(F.col("r.doc_id"))
        on = [F.col(f"e.{c}") == F.col(f"r.{c}") for c in by]
        first = rows.join(repeated.alias("r"), [*on, same_id], "left_semi").drop("doc_id")
        result = links.join(first, by, "left")
    result = shelf.put(result, "result")  # a table, so that the join below can split a hot text
    lone = F.col("group_size").isNull()
    is_best = F.when(F.col("copies") == 1, F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(
        F.col("row") == F.col("keep_row")
    )
    return entries.join(result, by, "left").select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(lone, True).otherwise(is_best).alias("kept"),
        "text_sha256",
        "source_key",
    )
