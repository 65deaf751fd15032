"""N-gram counts that reach the shuffle as packed numbers in place of text.

Nearly every three-word window of a corpus is different, so counting on the map side shrinks
them little, and as text they are many times the corpus. Here frequent words have a number,
by falling count, that all workers know; other words travel as text, once a block. A map task
counts the windows of up to a million places at a time, deals the different ones to buckets by
a hash of their words and sends each bucket's as one compressed block. A bucket's blocks are
added up by the words themselves, so hashes decide only where a window is counted. Buckets
are as many as the corpus needs for each to fit a worker, whatever the number of partitions,
and a hot n-gram is one entry a block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMON_WORDS = 1 << 19
COMMON_BYTES = 8 << 20
BUCKET_ENTRIES = 1 << 21
BUCKET_BYTES = 48 << 20
SIZES = (1, 2, 3)

_RANK_BITS = 21  # three ranks of words fit a long
_PLACES = 1 << 20  # of a block; with the two words after them they have fewer than 2 ** 21 ranks
_HELD_BYTES = 32 << 20  # of words before they are counted, of blocks sent at once
_OUT_ROWS = 100_000


def common_words(seen: DataFrame, classes: list[tuple[int, int, int]]) -> pa.Array:
    """The most frequent words of ``seen`` (gram, n_seen), most frequent first.

    ``classes`` has how many words, of how many bytes, occur so many times. Words that occur
    once gain nothing, and a count whose words no longer fit is left out with all below it.
    """
    least, words, size = None, 0, 0
    for n_seen, more, wide in sorted(classes, reverse=True):
        words, size = words + more, size + wide
        if n_seen < 2 or words > COMMON_WORDS or size > COMMON_BYTES:
            break
        least = n_seen
    if least is None:
        return pa.array([], pa.string())
    found = seen.where(f"n_seen >= {least}").select("gram", "n_seen").toArrow()
    order = [("n_seen", "descending"), ("gram", "ascending")]
    return found.sort_by(order)["gram"].combine_chunks().cast(pa.string())


def bucket_count(n_words: int, n_bytes: int, sizes: tuple[int, ...], least: int) -> int:
    """Buckets for all windows of so many words and bytes, none of them met twice."""
    entries, size = n_words * len(sizes), n_bytes * sum(sizes)
    return max(least, math.ceil(entries / BUCKET_ENTRIES), math.ceil(size / BUCKET_BYTES))


def packed_counts(
    docs: DataFrame, tokens: Column, common: pa.Array, sizes: tuple[int, ...], buckets: int
) -> DataFrame:
    """Counts (n, gram, n_seen) of the windows of ``sizes`` words; no word holds a blank or is null."""
    known = docs.sparkSession.sparkContext.broadcast(common)
    blocks = docs.select(tokens.alias("tokens")).mapInArrow(
        _pack(known, sizes, buckets), "bucket int, block binary"
    )
    parts = math.ceil(buckets / 3)
    dealt = blocks.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket")
    return dealt.mapInArrow(_add_up(known, sizes), "n int, gram string, n_seen long")


# -- map side ------------------------------------------------------------------------------


def _pack(known: Broadcast, sizes: tuple[int, ...], buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, left = pa.array([], pa.string()), np.zeros(0, np.int32)
        for batch in batches:
            more, own = _flat(batch.column(0))
            # Windows are cut off with the words after them, so a document may end in a later block.
            while len(words) + len(more) >= _PLACES + 2:
                taken = _PLACES + 2 - len(words)
                words = pa.concat_arrays([words, more[:taken]])
                left = np.concatenate([left, own[:taken]])
                yield from _blocks(words, left[:_PLACES], known.value, sizes, buckets)
                words, left = words[_PLACES:], left[_PLACES:]
                more, own = more[taken:], own[taken:]
            words, left = pa.concat_arrays([words, more]), np.concatenate([left, own])
            del batch, more, own  # before the next one is read
            if words.nbytes > _HELD_BYTES:  # a batch ends with its last document
                yield from _blocks(words, left, known.value, sizes, buckets)
                words, left = words[:0], left[:0]
        if len(left):
            yield from _blocks(words, left, known.value, sizes, buckets)

    return run


def _flat(lists: pa.ListArray) -> tuple[pa.StringArray, np.ndarray]:
    """All words, and for each how many words of its document there are from it on."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int32)
    left = np.repeat(ends, lengths)
    left -= np.arange(len(left), dtype=np.int32)
    return lists.flatten().cast(pa.string()), left


def _blocks(
    words: pa.Array, left: np.ndarray, common: pa.Array, sizes: tuple[int, ...], buckets: int
) -> Iterator[pa.RecordBatch]:
    """One row for each bucket with windows that begin at the first ``len(left)`` words.

    ``left`` has how many words of its document there are from a place on.
    """
    coded = words.dictionary_encode()
    own = coded.dictionary
    number = pc.fill_null(pc.index_in(own, value_set=common), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rare = np.flatnonzero(number < 0)
    others = own.take(pa.array(rare)).cast(pa.binary())
    mixed = _mixed(number.astype(np.uint64))
    if len(rare):
        sums = np.fromiter(map(zlib.crc32, others.to_pylist()), np.uint64, len(rare))
        mixed[rare] = _mixed(sums + np.uint64(1 << 32))
    number[rare] = len(common) + np.arange(len(rare))
    pa.default_memory_pool().release_unused()  # what the lookups took, before the sorts

    # Ranks have the order of the numbers and, unlike them, fit 21 bits.
    order = np.argsort(number)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    number, mixed = number[order].astype(np.uint32), mixed[order]
    at = np.concatenate([rank[coded.indices.to_numpy()], np.zeros(max(sizes), np.int32)])
    parts = [_dealt(at, left, number, mixed, n, buckets) for n in sizes]

    rows, blocks, size = [], [], 0
    for b in range(buckets):
        columns, counts = [], []
        for bounds, codes, n_seen in parts:
            columns.append([c[bounds[b] : bounds[b + 1]] for c in codes])
            counts.append(n_seen[bounds[b] : bounds[b + 1]])
        if any(len(c) for c in counts):
            rows.append(b)
            blocks.append(_block(columns, counts, others, len(common)))
            size += len(blocks[-1])
        if rows and (size > _HELD_BYTES or b == buckets - 1):
            sent = [pa.array(rows, pa.int32()), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(sent, ["bucket", "block"])
            rows, blocks, size = [], [], 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _dealt(
    at: np.ndarray, left: np.ndarray, number: np.ndarray, mixed: np.ndarray, n: int, buckets: int
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Different windows of n words by bucket, in order within it: bounds, numbers, counts."""
    key = np.zeros(len(left), np.int64)
    for i in range(n):
        key <<= _RANK_BITS
        key |= at[i : i + len(left)]
    key = key[left >= n]
    key.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    n_seen = np.diff(first, append=len(key)).astype(np.uint32)
    key = key[first]
    ranks = [((key >> (_RANK_BITS * (n - 1 - i))) & ((1 << _RANK_BITS) - 1)).astype(np.int32) for i in range(n)]
    del key, first
    hashed = np.full(len(n_seen), n, np.uint64)
    for r in ranks:
        hashed *= np.uint64(0x9E3779B97F4A7C15)
        hashed += mixed[r]
        hashed = _mixed(hashed)
    bucket = (hashed % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    del hashed
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return bounds, [number[r[order]] for r in ranks], n_seen[order]


# -- blocks: how many windows of each size and words there are, then zstd over byte planes ---


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _values(planes: memoryview, start: int, rows: int) -> np.ndarray:
    cut = np.frombuffer(planes, np.uint8, 4 * rows, start).reshape(4, rows)
    return np.ascontiguousarray(cut.T).view("<u4").reshape(rows)


def _block(columns: list[list[np.ndarray]], counts: list[np.ndarray], others: pa.Array, known: int) -> bytes:
    flat = np.concatenate([c for of in columns for c in of])
    rare = flat >= known
    used, place = np.unique(flat[rare], return_inverse=True)
    flat[rare] = known + place
    texts = others.take(pa.array(used - known)).to_pylist()
    parts, start = [], 0
    for of, n_seen in zip(columns, counts):
        for i, c in enumerate(of):
            own = flat[start : start + len(c)]
            # The first words rise within a bucket.
            parts.append(_planes(np.diff(own, prepend=np.uint32(0)) if i == 0 else own))
            start += len(c)
        parts.append(_planes(n_seen))
    parts += [_planes(np.array([len(t) for t in texts], np.uint32)), *texts]
    raw = b"".join(parts)
    head = np.array([len(raw), len(texts), *map(len, counts)], "<i8").tobytes()
    return head + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(block: bytes, sizes: tuple[int, ...]) -> tuple[list[list[np.ndarray]], pa.Array]:
    """Columns of numbers and counts for each size, and the words that have no number."""
    size, texts, *rows = np.frombuffer(block, "<i8", 2 + len(sizes)).tolist()
    raw = memoryview(pa.decompress(memoryview(block)[8 * (2 + len(sizes)) :], size, codec="zstd"))
    columns, start = [], 0
    for n, many in zip(sizes, rows):
        of = [_values(raw, start + 4 * many * i, many) for i in range(n + 1)]
        of[0] = np.cumsum(of[0], dtype=np.uint32)
        columns.append(of)
        start += 4 * many * (n + 1)
    ends = np.concatenate([[0], np.cumsum(_values(raw, start, texts))]).astype(np.int32)
    data = pa.py_buffer(raw[start + 4 * texts :])
    return columns, pa.StringArray.from_buffers(texts, pa.py_buffer(ends), data)


# -- reduce side -----------------------------------------------------------------------------


def _add_up(known: Broadcast, sizes: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if b != bucket and held:
                    yield from _totals(held, known.value, sizes)
                    held = []
                bucket = b
                held.append(_opened(block.as_py(), sizes))
        if held:
            yield from _totals(held, known.value, sizes)

    return run


def _totals(
    held: list[tuple[list[list[np.ndarray]], pa.Array]], common: pa.Array, sizes: tuple[int, ...]
) -> Iterator[pa.RecordBatch]:
    """Rows (n, gram, n_seen) of one bucket: equal windows of its blocks are added up."""
    coded = pa.concat_arrays([texts for _, texts in held]).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64) + len(common)
    names = pa.concat_arrays([common, coded.dictionary])
    starts = np.cumsum([0, *(len(texts) for _, texts in held)])
    for i, n in enumerate(sizes):
        columns = []
        for j in range(n):
            of = []
            for (parts, _), start in zip(held, starts):
                codes = parts[i][j].astype(np.int64)
                rare = codes >= len(common)
                codes[rare] = number[codes[rare] - len(common) + start]
                of.append(codes.astype(np.int32))
            columns.append(np.concatenate(of))
        n_seen = np.concatenate([parts[i][n] for parts, _ in held]).astype(np.int64)
        words = [f"w{j}" for j in range(n)]
        found = pa.table([*columns, n_seen], [*words, "n_seen"])
        added = found.group_by(words, use_threads=False).aggregate([("n_seen", "sum")])
        for start in range(0, len(added), _OUT_ROWS):
            own = added.slice(start, _OUT_ROWS).combine_chunks()
            gram = [names.take(own[w].combine_chunks()) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(own), n, np.int32)),
                    gram[0] if n == 1 else pc.binary_join_element_wise(*gram, " "),
                    own["n_seen_sum"].combine_chunks(),
                ],
                ["n", "gram", "n_seen"],
            )
