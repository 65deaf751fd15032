"""MinHash near-dedup with sequential Bayesian verification.

1. Each text gives the set of its five-word shingles as 64-bit hashes, a banded
   MinHash signature and a second, independent signature.  Texts with the same set
   become one class, named by its first row.
2. Classes that share a band are candidates.  Every bucket names one hub, the
   member that meets most others; each member is compared with the hub only, so
   a bucket gives as many pairs as it has members.
3. A pair's second signatures are compared in batches.  After each batch the
   posterior of the similarity (uniform prior) decides: a pair whose chance of
   reaching the threshold is below ``MISS`` is dropped.  Survivors are compared on
   their full sets.
4. Links are joined into components.  A bucket whose members all lie in one component
   is settled.  In the others, members of different components are compared with each
   other as well, in the first bucket that they share: pairs of blocks of bounded size
   go to tasks with their sets, and a task compares by posterior, then on full sets, and
   returns only links that join two components.  The components are then joined once more.

No pair of a shared bucket is left out unless both lie in one component already.
A pair is missed only if no band agrees, or by the posterior; the number of bands follows
from the threshold, so that either chance is below ``MISS`` for a pair at the threshold.
A large family whose members are all just below the threshold costs comparisons in
proportion to its square, spread over tasks, but no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import words as W
from leakscope.llm.graph import components
from leakscope.llm.shelf import Shelf

SHINGLE = 5
BANDS, ROWS = 20, 4  # bands at least
CHECKS, BATCH = 64, 16
MISS = 1e-6
BLOCK = 128
BLOCK_SHINGLES = 1 << 19
BROADCAST_ROWS = 1_000_000
_GROUP = 1 << 16


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer than five words are one shingle."""
    if not len(words):
        return words
    return np.unique(W.grams(words, min(SHINGLE, len(words))))


def band_count(percent: int) -> int:
    """Bands with which a pair at the threshold shares none in fewer than ``MISS`` cases."""
    apart = 1 - (percent / 100) ** ROWS
    if not 0 < apart < 1:
        return BANDS
    return max(BANDS, math.floor(math.log(MISS) / math.log(apart)) + 1)


@lru_cache(maxsize=4)
def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = W.mix(np.arange(1, 2 * n + 1, dtype=np.uint64), 0x5EED)
    return seeds[:n] | np.uint64(1), seeds[n:]


def signatures(sets: list[np.ndarray], bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(band keys, check signature) of each non-empty set."""
    a, b = _multipliers(bands * ROWS + CHECKS)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    flat = np.concatenate(sets)
    out = np.empty((len(a), len(sets)), np.uint64)
    for k in range(len(a)):
        out[k] = np.minimum.reduceat(flat * a[k] + b[k], starts)
    mins = out[: bands * ROWS].reshape(bands, ROWS, len(sets))
    keys = np.zeros((bands, len(sets)), np.uint64)
    for r in range(ROWS):
        keys = W.mix(keys + mins[:, r], r + 1)
    keys = W.mix(keys + np.arange(bands, dtype=np.uint64)[:, None])
    checks = (out[bands * ROWS :] >> np.uint64(32)).astype(np.uint32)
    return keys.T.view(np.int64), np.ascontiguousarray(checks.T)


def _sets(texts: list[bytes]) -> Iterator[tuple[int, list[np.ndarray]]]:
    for lo, hi in W.groups(texts):
        words, counts = W.many_word_hashes([W.lower(t) for t in texts[lo:hi]])
        at = np.concatenate([[0], np.cumsum(counts)])
        yield lo, [shingle_set(words[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    total = lambda x: int(np.sum(x, dtype=np.uint64).view(np.int64))
    return total(W.mix(s, 0xA11)), total(W.mix(s, 0xB22))


def _sign(n_bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in _sets(W.utf8(batch.column(2))):
                full = [k for k, s in enumerate(sets) if len(s)]
                prints = [_fingerprint(s) for s in sets]
                bands: list = [None] * len(sets)
                checks: list = [None] * len(sets)
                if full:
                    keys, mins = signatures([sets[k] for k in full], n_bands)
                    for k, row, own in zip(full, keys, mins, strict=True):
                        bands[k], checks[k] = row, own.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(sets)),
                        batch.column(1).slice(lo, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(checks, pa.binary()),
                    ],
                    ["doc_id", "source_key", "n_shingles", "set_a", "set_b", "bands", "checks"],
                )

    return run


def _write_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, sets in _sets(W.utf8(batch.column(1))):
            prints = [_fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["set_a", "set_b", "shingles"],
            )


@lru_cache(maxsize=32)
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the matches below which the threshold is out of reach.

    With m of n matches the posterior is Beta(m + 1, n - m + 1); its mass above t
    is the chance of at most m successes in n + 1 draws of probability t.
    """
    least = []
    for n in range(BATCH, CHECKS + 1, BATCH):
        mass, m = 0.0, 0
        while True:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= miss:
                break
            m += 1
        least.append(m)
    return tuple(least)


def possible(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of two check signatures survive all batches."""
    alive = np.arange(len(left))
    seen = np.zeros(len(left), np.int64)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        seen[alive] += (left[alive, part] == right[alive, part]).sum(axis=1)
        alive = alive[seen[alive] >= least]
    return alive


def _signature_rows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, CHECKS)


def _prune(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive = possible(
                _signature_rows(batch.column(2)), _signature_rows(batch.column(3)), threshold
            )
            yield batch.select([0, 1]).take(pa.array(alive))

    return run


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of some others."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    heads = np.concatenate([[0], np.cumsum([len(o) for o in others])[:-1]])
    return np.add.reduceat((one[at] == flat).astype(np.int64), heads)


def block_links(key: int, i: int, j: int, members: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links that join different components, between two blocks of one bucket.

    ``members`` have node, comp, block, bands, checks and shingles.
    """
    node = [m["node"] for m in members]
    comp = np.array([m["comp"] for m in members])
    block = np.array([m["block"] for m in members])
    bands = np.array([m["bands"] for m in members])
    sig = np.frombuffer(b"".join(m["checks"] for m in members), np.uint32).reshape(-1, CHECKS)
    sets = [np.asarray(m["shingles"], np.int64) for m in members]
    rest, links = np.flatnonzero(block == j), []
    for k in np.flatnonzero(block == i):
        other = rest[comp[rest] != comp[k]]
        if i == j:
            other = other[other > k]
        same = bands[other] == bands[k]
        other = other[bands[k][same.argmax(axis=1)] == key]  # the first band they share
        left = np.broadcast_to(sig[k], (len(other), CHECKS))
        other = other[possible(left, sig[other], percent / 100)]
        if not len(other):
            continue
        common = _common(sets[k], [sets[o] for o in other])
        union = np.array([len(sets[o]) for o in other]) + len(sets[k]) - common
        for o in other[100 * common >= percent * union]:
            if comp[o] != comp[k]:
                links.append((min(node[k], node[o]), max(node[k], node[o])))
                comp[comp == comp[o]] = comp[k]
    return links


def _compare_blocks(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                links = block_links(row["key"], row["i"], row["j"], row["members"], percent)
                if links:
                    a, b = zip(*links, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


class _Run:
    def __init__(self, docs: DataFrame, percent: int) -> None:
        self.percent = percent
        self.shelf = Shelf(docs.sparkSession, "near")
        self.docs = docs.select(
            "doc_id", F.xxhash64("doc_id", "text").alias("source_key"), "text"
        )
        schema = (
            "doc_id long, source_key long, n_shingles long, set_a long, set_b long, "
            "bands array<long>, checks binary"
        )
        self.rows = self.shelf.put(
            self.docs.mapInArrow(_sign(band_count(percent)), schema).withColumn("row", F.monotonically_increasing_id()),
            "rows",
        )
        self.classes = self.shelf.put(
            self.rows.where("n_shingles > 0")
            .groupBy("set_a", "set_b")
            .agg(
                F.min("row").alias("node"),
                F.min("doc_id").alias("low"),
                F.coalesce(F.min_by("row", "doc_id"), F.min("row")).alias("keep"),
            ),
            "classes",
        )
        self.reps = self.shelf.put(
            self.rows.join(self.classes.select(F.col("node").alias("row")), "row").select(
                F.col("row").alias("node"), "source_key", "n_shingles", "set_a", "set_b", "bands", "checks"
            ),
            "reps",
        )

    def _near(self, df: DataFrame) -> DataFrame:
        """For a join of few rows: sent to every task while their number is bounded."""
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    def candidates(self) -> tuple[DataFrame, DataFrame]:
        """(key, node) of shared buckets, and (key, hub)."""
        keyed = self.reps.select("node", F.explode("bands").alias("key"))
        sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = self.shelf.put(keyed.join(sizes, "key"), "shared")
        meets = shared.groupBy("node").agg(F.sum("n").alias("meets"))
        hubs = shared.join(meets, "node").groupBy("key").agg(
            F.max(F.struct("meets", "node"))["node"].alias("hub")
        )
        return shared, self.shelf.put(hubs, "hubs")

    def sets(self, nodes: DataFrame, name: str) -> DataFrame:
        """(node, shingles) of some classes, from their texts."""
        needed = self.shelf.put(
            nodes.distinct().join(self.reps.select("node", "source_key", "set_a", "set_b"), "node"),
            f"{name}-needed",
        )
        texts = self.docs.join(self._near(needed.select("source_key").distinct()), "source_key", "left_semi")
        sets = texts.select("source_key", "text").mapInArrow(
            _write_sets, "set_a long, set_b long, shingles array<long>"
        )
        return self.shelf.put(
            needed.join(sets, ["set_a", "set_b"]).select("node", "shingles").dropDuplicates(["node"]),
            f"{name}-sets",
        )

    def exact(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) whose full sets reach the threshold."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), name)
        common = F.size(F.array_intersect("x", "y")).cast("long")
        union = F.size("x").cast("long") + F.size("y").cast("long") - common
        return self.shelf.put(
            pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
            .where(100 * common >= self.percent * union)
            .select("a", "b"),
            f"{name}-links",
        )

    def components(self) -> DataFrame:
        shared, hubs = self.candidates()
        first = (
            shared.join(hubs, "key")
            .where("node <> hub")
            .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
            .distinct()
        )
        check = self.reps.select("node", "checks")
        first = self.shelf.put(
            first.join(check.select(F.col("node").alias("a"), F.col("checks").alias("x")), "a")
            .join(check.select(F.col("node").alias("b"), F.col("checks").alias("y")), "b")
            .select("a", "b", "x", "y")
            .mapInArrow(_prune(self.percent / 100), "a long, b long"),
            "first",
        )
        links = self.exact(first, "first")
        comps = components(links, self.shelf, "early")
        # Hubs are done: each was compared with every member of its bucket.
        rest = (
            shared.join(hubs, "key")
            .where("node <> hub")
            .join(comps, "node", "left")
            .select("key", "node", F.coalesce("comp", "node").alias("comp"))
        )
        rest = self.shelf.put(rest, "rest")
        weights = self.reps.select("node", "n_shingles")
        open_keys = (
            rest.join(weights, "node")
            .groupBy("key")
            .agg(
                F.min("comp").alias("lo"),
                F.max("comp").alias("hi"),
                F.ceil(
                    F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
                ).cast("int").alias("blocks"),
            )
            .where("lo < hi")
            .select("key", "blocks")
        )
        members = self.shelf.put(rest.join(open_keys, "key"), "members")
        full = self.sets(members.select("node"), "second").join(
            self.reps.select("node", "bands", "checks"), "node"
        )
        spread = (
            members.join(full, "node")
            .withColumn("block", F.pmod(F.hash("node"), "blocks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                "key",
                F.least("block", "other").alias("i"),
                F.greatest("block", "other").alias("j"),
                F.struct("node", "comp", "block", "bands", "checks", "shingles").alias("m"),
            )
        )
        more = self.shelf.put(
            spread.groupBy("key", "i", "j")
            .agg(F.collect_list("m").alias("members"))  # two blocks, bounded in rows and shingles
            .mapInArrow(_compare_blocks(self.percent), "a long, b long")
            .distinct(),
            "second-links",
        )
        return components(links.unionByName(more), self.shelf, "all")


def near_dedup(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, source_key) for every row of (doc_id, text).

    Texts are linked if 100 * |common shingles| >= percent * |all shingles|; a
    component is named by its smallest doc_id, and one row with that id is kept.
    Null, empty and blank texts have no shingles, stand alone and are kept.  Null
    ids take part; one row of a component without any id is kept, and its component_id is
    null.  Rows that repeat an id and a text are alike but for ``kept``.  Other columns
    are ignored; an empty table gives an empty result.
    """
    run = _Run(docs, percent)
    found = run.components()
    classes = run.classes.join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lows = classes.groupBy("comp").agg(
        F.min("low").alias("component_id"),
        F.coalesce(F.min_by("keep", "low"), F.min("keep")).alias("keep_row"),
    )
    named = run.shelf.put(
        classes.join(lows, "comp").select("set_a", "set_b", "component_id", "keep_row"), "named"
    )
    some = F.col("n_shingles") > 0
    return (
        run.rows.select("doc_id", "n_shingles", "set_a", "set_b", "row", "source_key")
        .join(named, ["set_a", "set_b"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(some, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.when(some, F.col("row") == F.col("keep_row")).otherwise(True).alias("kept"),
            "source_key",
        )
    )
