"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints of 64 bits link when at most ``distance`` bits differ.  If the bits are cut
into parts with thresholds t_1 .. t_m, where the sum of (t_i + 1) is distance + 1, then two
linked fingerprints differ in at most t_i bits of some part i; a part with threshold -1 is
not looked at.

1. Every different fingerprint counts once, with its smallest doc_id.
2. Correlations of the bits over all fingerprints group bits into parts: correlated bits
   go together, so that one part carries the skew and the others stay selective.  There is
   one arrangement for each number of parts from 1 to distance + 1.
3. Each fingerprint gets its own thresholds.  Candidates of a part are estimated from the
   exact size of its own bucket, and from counts of short pieces of the part at each
   distance.  Dynamic programming over the parts finds the thresholds of least cost
   (probes and candidates) in each arrangement; the cheapest arrangement is taken.
4. The fingerprint probes all values within its thresholds; a join with the index of all
   fingerprints verifies the whole distance.  Links become components.

The arrangement of one part has no wrong candidates and a fixed number of probes (2,081 for
distance 2), so the cost of a fingerprint is bounded however large its buckets are: a hot
bucket is compared by probes of its members and not pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.graph import components
from leakscope.llm.shelf import Shelf
from leakscope.llm.words import lower, slices, utf8

BITS = 64
# Bits of a part whose values are counted together for the estimates: at most 2,048 values.
PIECE = 11
# Cost of a probe against that of a candidate.
PROBE_COST = 2.0
# Hashes, and probes, held at once.
HELD = 1 << 20
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words joined by one space, repeats included.

    A text with fewer words gives one hash of all of them, a text without words none.
    """
    from xxhash import xxh64_intdigest

    found, carried = [], []
    for part in slices(lower(text)):
        own = carried + part.split()
        joined = b" ".join(own)
        ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(own)]
        runs = map(slice, starts[: len(own) - words + 1].tolist(), ends[words - 1 :].tolist())
        if len(own) >= words:
            hashed = map(xxh64_intdigest, map(joined.__getitem__, runs), repeat(42))
            found.append(np.fromiter(hashed, np.uint64, len(own) - words + 1))
        carried = own[len(own) - words + 1 :] if len(own) >= words else own
    if not found and carried:
        return np.array([xxh64_intdigest(b" ".join(carried), 42)], np.uint64)
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``counts`` hashes: bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    # Eight counters of a byte lie in one number, so at most 255 hashes are added up at once.
    blocks = -(-n // 255)
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(int(blocks.sum())) - np.repeat(first_block, blocks)
    at = np.repeat(np.cumsum(n) - n, blocks) + 255 * within
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block)
        for j in range(8):
            out[some] |= (2 * sums[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            prints = majority(np.concatenate(held), np.array([len(h) for h in held]))
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(prints.view(np.int64))], ["doc_id", "print"]
            )

        for batch in batches:
            ids, held, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                ids.append(doc_id)
                held.append(shingle_hashes(text, words))
                size += len(held[-1])
                if size > HELD:
                    yield out()
                    ids, held, size = [], [], 0
            if ids:
                yield out()

    return run


def _bit_table(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _common_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many fingerprints of the task have both bits i and j: (cell = 64 i + j, n)."""
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        bits = _bit_table(batch.column(0).to_numpy()).astype(np.float64)
        total += np.rint(bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], ["cell", "n"]
    )


def correlations(common: np.ndarray, n: int) -> np.ndarray:
    """Absolute correlation of every two bits; bits that never change have none."""
    ones = np.diag(common).astype(float)
    spread = np.sqrt(ones * (n - ones))
    below = np.outer(spread, spread)
    found = np.abs(n * common.astype(float) - np.outer(ones, ones))
    return np.divide(found, below, out=np.zeros_like(found), where=below > 0)


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into parts of nearly equal size, correlated bits together.

    A part starts with the strongest pair left over and takes the bit with the highest sum
    of correlations to its bits until it is full; ties go to the lowest bit.
    """
    left = list(range(BITS))
    found = []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        if size >= len(left):
            part = left
        else:
            pairs = np.triu(corr[np.ix_(left, left)] + 1, 1)
            part = [left[x] for x in np.unravel_index(int(np.argmax(pairs)), pairs.shape)]
            while len(part) < size:
                rest = [b for b in left if b not in part]
                part.append(rest[int(np.argmax(corr[np.ix_(rest, part)].sum(axis=1)))])
        found.append(sorted(part))
        left = [b for b in left if b not in part]
    return found


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Pieces:
    """Counts of the values of a part's pieces at distance 0, 1 and more, over all fingerprints."""

    def __init__(self, bits: list[int]) -> None:
        self.cuts = [bits[k : k + PIECE] for k in range(0, len(bits), PIECE)]
        self.near: list[np.ndarray] = []

    def fill(self, counts: list[dict[int, int]], distance: int) -> None:
        """``counts`` has, for each piece, how many fingerprints have a value (of compact bits)."""
        for cut, seen in zip(self.cuts, counts, strict=True):
            rows = [np.zeros(1 << len(cut))]
            rows[0][list(seen)] = list(seen.values())
            own = np.arange(1 << len(cut))
            before = np.zeros_like(rows[0])
            for d in range(1, distance + 1):
                # One more flip leads to distance d from below, or back from it.
                ahead = sum(rows[-1][own ^ (1 << b)] for b in range(len(cut)))
                ahead = (ahead - (len(cut) - d + 2) * before) / d
                before = rows[-1]
                rows.append(ahead)
            self.near.append(np.array(rows))

    def shares(self, bits: np.ndarray, total: int) -> np.ndarray:
        """Share of fingerprints at each distance from each row, pieces taken as independent."""
        depth = self.near[0].shape[0]
        found = np.zeros((depth, len(bits)))
        found[0] = 1
        for cut, near in zip(self.cuts, self.near, strict=True):
            own = near[:, bits[:, cut] @ (1 << np.arange(len(cut)))] / total
            found = np.array([sum(found[a] * own[d - a] for a in range(d + 1)) for d in range(depth)])
        return found


def allocate(costs: list[np.ndarray], budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of least cost: ``costs[i][t + 1]`` is what threshold t of part i costs each row.

    The sum of (t_i + 1) is ``budget``.  Returns the cost of each row, and thresholds by
    part and row; the smaller threshold of an earlier part wins ties.
    """
    rows = costs[0].shape[1]
    best = np.full((budget + 1, rows), np.inf)
    best[0] = 0
    chosen = []
    for cost in costs:
        fresh = np.full_like(best, np.inf)
        pick = np.zeros(best.shape, np.int64)
        for s in range(budget + 1):
            for step in range(min(s + 1, len(cost))):
                value = best[s - step] + cost[step]
                better = value < fresh[s]
                fresh[s][better] = value[better]
                pick[s][better] = step
        best = fresh
        chosen.append(pick)
    at = np.full(rows, budget)
    taken = np.zeros((len(costs), rows), np.int64)
    for i in range(len(costs) - 1, -1, -1):
        taken[i] = chosen[i][at, np.arange(rows)]
        at = at - taken[i]
    return best[budget], taken - 1


class Plan:
    """Arrangements of the bits, and the thresholds and probes of fingerprints."""

    def __init__(self, corr: np.ndarray, distance: int) -> None:
        self.distance = distance
        self.arrangements: list[list[int]] = []  # numbers of parts
        self.parts: list[list[int]] = []
        for m in range(1, distance + 2):
            own = group_bits(corr, m)
            self.arrangements.append(list(range(len(self.parts), len(self.parts) + m)))
            self.parts += own
        self.masks = [_signed(_mask(p)) for p in self.parts]
        self.pieces = [Pieces(p) for p in self.parts]
        self.total = 0

    def fill(self, counts: dict[tuple[int, int], dict[int, int]], total: int) -> None:
        self.total = total
        for p, pieces in enumerate(self.pieces):
            pieces.fill([counts[p, k] for k in range(len(pieces.cuts))], self.distance)

    def thresholds(self, prints: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Thresholds by part and row; -1 for parts not looked at.

        ``own`` has the size of each row's bucket by part.
        """
        bits = _bit_table(prints).astype(np.int64)
        best = np.full(len(prints), np.inf)
        found = np.full((len(self.parts), len(prints)), -1)
        for numbers in self.arrangements:
            costs = []
            for p in numbers:
                width = len(self.parts[p])
                shares = self.pieces[p].shares(bits, self.total)
                inside = np.maximum(own[p] - 1, self.total * shares[0])
                near = np.cumsum(inside * shares / shares[0], axis=0)
                probes = np.cumsum([comb(width, d) for d in range(self.distance + 1)])
                if len(numbers) == 1:
                    near = np.zeros_like(near)  # whole fingerprints: no wrong candidates
                costs.append(np.vstack([np.zeros(len(prints)), PROBE_COST * probes[:, None] + near]))
            cost, taken = allocate(costs, self.distance + 1)
            better = cost < best
            best[better] = cost[better]
            found[:, better] = -1
            for p, row in zip(numbers, taken, strict=True):
                found[p, better] = row[better]
        return found

    def flips(self, part: int, threshold: int) -> np.ndarray:
        """Differences within the threshold, the part's own value first."""
        bits = self.parts[part]
        sets = [c for d in range(threshold + 1) for c in combinations(bits, d)]
        return np.array([_mask(list(c)) for c in sets], np.uint64)


def _probes(plan: Plan):
    """(print, low, sizes of its buckets by part) to (part, value, print, low)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            lows = batch.column(1)
            own = np.array(batch.column(2).to_pylist(), np.int64).reshape(len(prints), -1).T
            if not len(prints):
                continue
            taken = plan.thresholds(prints, own)
            for part in range(len(plan.parts)):
                mask = np.int64(plan.masks[part]).view(np.uint64)
                for t in range(plan.distance + 1):
                    rows = np.flatnonzero(taken[part] == t)
                    flips = plan.flips(part, t)
                    step = max(1, HELD // len(flips))
                    for first in range(0, len(rows), step):
                        some = rows[first : first + step]
                        values = (prints[some][:, None] ^ flips) & mask
                        wanted = np.ones(values.shape, bool)
                        wanted[:, 0] = own[part][some] > 1  # nobody else has the own value
                        which, _ = np.nonzero(wanted)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(which), part, np.int32)),
                                pa.array(values[wanted].view(np.int64)),
                                pa.array(prints[some][which].view(np.int64)),
                                lows.take(pa.array(some[which])),
                            ],
                            ["part", "value", "print", "low"],
                        )

    return run


def _index(prints: DataFrame, plan: Plan, numbers: list[int]) -> DataFrame:
    """(part, value, print, low) of every fingerprint for the given parts."""
    parts = [
        F.struct(F.lit(p).alias("part"), F.col("print").bitwiseAND(F.lit(plan.masks[p])).alias("value"))
        for p in numbers
    ]
    return prints.select(F.inline(F.array(*parts)), "print", "low")


def _piece_counts(prints: DataFrame, plan: Plan) -> dict[tuple[int, int], dict[int, int]]:
    """Counts of the values of all pieces: at most 2 ** PIECE for each."""
    names = [(p, k) for p, pieces in enumerate(plan.pieces) for k in range(len(pieces.cuts))]

    def compact(cut: list[int]) -> Column:
        return sum(
            (
                F.shiftleft(F.shiftrightunsigned("print", b).bitwiseAND(F.lit(1)), i)
                for i, b in enumerate(cut)
            ),
            F.lit(0).cast("long"),
        )

    values = [
        F.struct(F.lit(q).alias("piece"), compact(plan.pieces[p].cuts[k]).alias("value"))
        for q, (p, k) in enumerate(names)
    ]
    rows = prints.select(F.inline(F.array(*values))).groupBy("piece", "value").count().collect()
    found: dict[tuple[int, int], dict[int, int]] = {name: {} for name in names}
    for piece, value, n in rows:
        found[names[piece]][value] = n
    return found


def _links(prints: DataFrame, plan: Plan, shelf: Shelf) -> DataFrame:
    """(a, a_low, b, b_low): fingerprints that differ in at most ``distance`` bits."""
    every = list(range(len(plan.parts)))
    sizes = _index(prints, plan, every).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    # A bucket of one is known from its absence.
    shared = shelf.put(sizes.where("n > 1"), "sizes")
    counted = _index(prints, plan, every).join(shared, ["part", "value"]).groupBy("print").agg(
        F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("sizes")
    )
    own = F.array(
        *[F.coalesce(F.try_element_at("sizes", F.lit(p)), F.lit(1).cast("long")) for p in every]
    )
    described = prints.join(counted, "print", "left").select("print", "low", own.alias("own"))
    probes = shelf.put(
        described.mapInArrow(_probes(plan), "part int, value long, print long, low long"), "probes"
    )
    used = [r[0] for r in probes.select("part").distinct().collect()]
    if not used:
        return probes.select(
            F.col("print").alias("a"), F.col("low").alias("a_low"), F.col("print").alias("b"), F.col("low").alias("b_low")
        )
    index = _index(prints, plan, sorted(used)).withColumnsRenamed({"print": "b", "low": "b_low"})
    near = F.bit_count(F.col("print").bitwiseXOR(F.col("b"))) <= plan.distance
    return (
        probes.join(index, ["part", "value"])
        .where(near & (F.col("b") > F.col("print")))
        .select(F.col("print").alias("a"), F.col("low").alias("a_low"), "b", "b_low")
    )


def _decimal(x: int) -> Column:
    return F.lit(str(x)).cast("decimal(20,0)")


def _node(fingerprint: str, low: str) -> Column:
    """The smallest doc_id, or beyond all of them a number of the fingerprint's own."""
    rank = F.col(fingerprint).cast("decimal(20,0)") + _decimal(1 << 64)
    return F.coalesce(F.col(low).cast("decimal(20,0)"), rank.cast("decimal(20,0)"))


def simhash_dedup(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, print, component_id) for every row of (doc_id, text).

    ``print`` is the fingerprint as a signed long.  A-Z count as a-z.  A text with fewer
    words than ``words`` has one shingle of all of them; a text without words and a null
    text have fingerprint zero, which links like any other.  A component is named by its
    smallest doc_id; it is null where no document of it has an id.  Repeated rows and ties
    share their fingerprint and so their component.  Whole texts are read, very long ones
    in parts.  Other columns are ignored; an empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession, "simhash")
    rows = shelf.put(
        docs.select("doc_id", "text").mapInArrow(_fingerprints(words), "doc_id long, print long"),
        "prints",
    )
    return print_components(rows, distance)


def print_components(rows: DataFrame, distance: int = 2) -> DataFrame:
    """(doc_id, print, component_id) for every row of (doc_id, print); see ``simhash_dedup``."""
    shelf = Shelf(rows.sparkSession, "prints")
    prints = shelf.put(rows.groupBy("print").agg(F.min("doc_id").alias("low")), "distinct")
    cells = prints.select("print").mapInArrow(_common_bits, "cell long, n long")
    common = np.zeros(BITS * BITS, np.int64)
    for cell, n in cells.groupBy("cell").sum("n").collect():  # 64 x 64 sums
        common[cell] = n
    total = prints.count()
    plan = Plan(correlations(common.reshape(BITS, BITS), total), distance)
    if total:
        plan.fill(_piece_counts(prints, plan), total)
    links = shelf.put(_links(prints, plan, shelf), "links")
    nodes = links.select(_node("a", "a_low").alias("a"), _node("b", "b_low").alias("b"))
    found = components(nodes, shelf, "all")
    comp = F.coalesce("comp", "node")
    named = F.when(comp < _decimal(1 << 63), comp.cast("long"))
    classes = shelf.put(
        prints.select("print", _node("print", "low").alias("node"))
        .join(found, "node", "left")
        .select("print", named.alias("component_id")),
        "classes",
    )
    return rows.join(classes, "print").select("doc_id", "print", "component_id")
