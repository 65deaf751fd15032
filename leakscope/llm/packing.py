"""Packing into fixed-length sequences by cutting-stock column generation.

A document of n ids is cut into full sequences and one rest.  Rests are counted by
length in steps of ``STEP`` ids.  On these counts (a few hundred numbers, whatever the
input) the driver solves the linear program that covers all rests with the fewest
sequences: the columns are patterns of lengths that fit one sequence, and a knapsack
dynamic program over the dual prices finds the next column until none improves.
Pattern counts are rounded down, what is left is filled largest first.

The documents of each length are ranked in parallel, and ranks are dealt to patterns
by arithmetic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leakscope.llm.bpe import encoded_column, shared_encoder
from leakscope.llm.shelf import Shelf

STEP = 8
CELLS = 4096
ROUNDS = 1000
GAP = 5e-4  # of the number of sequences, above the optimum of the linear program


def price(duals: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of the largest total dual price: an unbounded knapsack."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    for c in range(1, room + 1):
        fit = np.searchsorted(sizes, c, side="right")
        if fit:
            value = best[c - sizes[:fit]] + duals[:fit]
            k = int(value.argmax())
            if value[k] > best[c - 1] + 1e-12:
                best[c], pick[c] = value[k], k
                continue
        best[c] = best[c - 1]
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return float(best[room]), pattern


def first_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest-first patterns, each used until one of its sizes is used up.

    A pattern holds no size that ran out before, so the patterns are independent.
    """
    left, basis, counts = demand.astype(float), [], []
    open_sizes = np.ones(len(sizes), bool)
    for _ in sizes:
        free, pattern = room, np.zeros(len(sizes))
        for k in np.flatnonzero(open_sizes)[::-1]:
            pattern[k] = free // sizes[k]
            free -= int(pattern[k]) * sizes[k]
        ratio = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        k = int(ratio.argmin())
        basis.append(pattern)
        counts.append(max(ratio[k], 0.0))
        left -= counts[-1] * pattern
        open_sizes[k] = False
    return np.array(basis).T, np.array(counts)


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; small matrices do without BLAS threads."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        top = k + int(np.abs(both[k:, k]).argmax())
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, rounds: int = ROUNDS
) -> tuple[list[np.ndarray], np.ndarray]:
    """Patterns and their (fractional) counts of a nearly optimal basis; ``sizes`` ascend.

    When the best column is worth v, the optimum is at least the cover found over v, so
    the search ends at v <= 1 + gap, or after ``rounds`` columns with the cover it has.
    """
    n = len(sizes)
    basis, counts = first_basis(sizes, demand, room)
    inverse = _inverse(basis)
    for _ in range(rounds):
        value, pattern = price(inverse.sum(axis=0), sizes, room)
        move = (inverse * pattern).sum(axis=1)
        up = move > 1e-9
        if value <= 1 + gap or not up.any():
            break
        ratio = np.where(up, counts / np.where(up, move, 1), np.inf)
        out = int(ratio.argmin())
        counts = np.maximum(counts - ratio[out] * move, 0)
        counts[out] = ratio[out]
        basis[:, out] = pattern
        row = inverse[out] / move[out]
        inverse -= move[:, None] * row
        inverse[out] = row
    return [basis[:, k].astype(np.int64) for k in range(n)], counts


def patterns(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """(number of sequences, {length: pieces in each}) that cover the histogram exactly."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[s] for s in sizes], np.int64)
    out = []
    if len(sizes):
        basis, counts = column_generation(sizes, left.astype(float), room)
        for k in np.argsort(-counts, kind="stable"):
            p, used = basis[k], basis[k] > 0
            n = min(int(counts[k] + 1e-6), int((left[used] // p[used]).min()))
            if n > 0:
                out.append((n, {int(s): int(a) for s, a in zip(sizes, p, strict=True) if a}))
                left -= n * p
    while left.any():  # fewer pieces than the basis holds: largest first into one sequence
        free, mixed = room, {}
        for k in reversed(range(len(sizes))):
            n = int(min(left[k], free // sizes[k]))
            if n:
                mixed[int(sizes[k])] = n
                left[k] -= n
                free -= n * int(sizes[k])
        out.append((1, mixed))
    return out


def _pieces(path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for k, found in encoded_column(encoder, b.column(1)):
                own = np.append(found, end_id).astype("<u4")
                for a in range(0, len(own), length):
                    part = own[a : a + length]
                    rows.append((ids[k], a, len(part), zlib.crc32(part), len(own)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every document (doc_id, text) is encoded and followed by ``end_id``; a null text
    counts as empty.  Null and repeated ids and repeated rows are packed like any other
    row.  Other columns are ignored; an empty table gives an empty result.
    """
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    found = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, length), kind)
    return pack_pieces(found, length)


def pack_pieces(pieces: DataFrame, length: int, step: int = STEP) -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``length`` (column ``length``)."""
    spark = pieces.sparkSession
    shelf = Shelf(spark, "packing")
    names = pieces.columns
    room = length // step
    size = F.ceil(F.col("length") / step).cast("int")
    laid = shelf.put(
        pieces.withColumn("pack_row", F.monotonically_increasing_id())
        .withColumn("pack_size", size)
        .withColumn("pack_cell", F.pmod(F.xxhash64("pack_row"), F.lit(CELLS)).cast("int")),
        "pieces",
    )
    along = Window.partitionBy("pack_size").orderBy("pack_cell").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cells = laid.groupBy("pack_size", "pack_cell").agg(F.count(F.lit(1)).alias("n"))
    before = cells.withColumn("pack_before", F.coalesce(F.sum("n").over(along), F.lit(0))).drop("n")
    histogram = {r[0]: r[1] for r in laid.groupBy("pack_size").count().collect()}
    plan, first = [], 0
    taken = dict.fromkeys(histogram, 0)
    for n, mixed in patterns(histogram, room):
        for s, a in mixed.items():
            plan.append((s, taken[s], taken[s] + n * a, a, first))
            taken[s] += n * a
        first += n
    table = spark.createDataFrame(
        plan, "pack_size int, pack_lo long, pack_hi long, pack_each long, pack_first long"
    )
    inside = Window.partitionBy("pack_size", "pack_cell").orderBy("pack_row")
    rank = F.col("pack_rank") - F.col("pack_lo")
    dealt = (
        laid.join(before, ["pack_size", "pack_cell"])
        .withColumn("pack_rank", F.col("pack_before") + F.row_number().over(inside) - 1)
        .join(F.broadcast(table), "pack_size")  # a few rows a length
        .where("pack_rank >= pack_lo and pack_rank < pack_hi")
        .withColumn("sequence_id", F.col("pack_first") + F.floor(rank / F.col("pack_each")))
    )
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "pack_row")
    offset = F.coalesce(
        F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return dealt.select(*names, "sequence_id", offset.alias("offset"))
