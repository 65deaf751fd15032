"""Substring dedup by a relative Lempel-Ziv parse over all earlier text.

1. Blocks.  In each window of ``window`` words the smallest hash of a gram of half the
   window and one word is its anchor; equal windows have equal anchors, and those that
   follow one another overlap or touch.  Every document is cut at its anchors into such
   reference blocks, and each block is indexed by the first place where it starts.
   Anchors that occur once cannot lie in a repeated window, so only the words around
   repeated ones go on.
2. Factors.  A document is parsed from left to right: a factor begins at an anchor that
   starts earlier and grows as long as the next anchor continues the same reference,
   that is, first starts as many words further on there as here.  As anchors leave no
   word between them, all words of a factor equal those of its reference.  Windows inside a
   factor are repeated.
3. Boundaries.  Greedy factors end where their reference changes, and a repeated window may
   cross such an end.  So all windows around anchors that no factor holds are compared
   by a 128-bit fingerprint; the first place of each is kept, the others are repeated too.  The
   first occurrence of a window lies in no factor, so it is always among those.
4. Repeated windows that overlap or touch are merged to spans, and words in spans removed.

Documents with the same words are parsed once: the first is the reference of the
others, which are one factor each if they have a window at all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import words as W
from leakscope.llm.shelf import Shelf

WINDOW = 20


def block_size(window: int) -> int:
    """Words of an anchor: as many as two that follow one another may lie apart, or one more."""
    return window // 2 + 1


def text_words(text: bytes) -> list[bytes]:
    """Words as bytes; only the six ASCII white-space characters part them."""
    return text.split()


def anchor_places(words: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the anchors of all windows of one text; leftmost of equal ones."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = block_size(window)
    g = W.grams(words, size)
    span = window - size + 1
    best = g[: len(g) - span + 1].copy()
    at = np.arange(len(best))
    for k in range(1, span):
        other = g[k : k + len(best)]
        less = other < best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + k
    at = np.unique(at)
    return g[at], at


def _scan(window: int):
    """(doc_id, text) -> words, hash of the kept words without removal, anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.utf8(batch.column(2))
            for lo, hi in W.groups(texts):
                words, counts = W.many_word_hashes(texts[lo:hi])
                upto = np.concatenate([[0], np.cumsum(counts)])
                found = [anchor_places(words[a:b], window) for a, b in zip(upto[:-1], upto[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(counts, pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(text_words(t))).hexdigest() for t in texts[lo:hi]]),
                        pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                        pa.array([p.astype(np.int32) for _, p in found], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "source_key", "n_words", "whole_sha256", "anchors", "places"],
                )

    return run


def near_anchor(n_words: int, places: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold one of these anchors."""
    size = block_size(window)
    inside = np.zeros(n_words + 2, np.int64)
    np.add.at(inside, np.maximum(places + size - window, 0), 1)
    np.add.at(inside, places + 1, -1)
    return np.flatnonzero(np.cumsum(inside)[: max(0, n_words - window + 1)] > 0)


def parse(own: np.ndarray, ref: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Greedy factors (from, to, reference of the first word), of at least a window each.

    ``own`` has the places of repeated anchors in order, ``ref`` where each starts first; places
    of all documents are on one scale, and an anchor without an earlier one refers to itself.
    """
    if not len(own):
        return []
    size = block_size(window)
    gap = np.diff(own)
    goes_on = (np.diff(ref) == gap) & (gap <= size)
    firsts = np.concatenate([[0], np.flatnonzero(~goes_on) + 1])
    lasts = np.concatenate([firsts[1:] - 1, [len(own) - 1]])
    long = (ref[firsts] < own[firsts]) & (own[lasts] + size - own[firsts] >= window)
    return [
        (int(own[a]), int(own[b]) + size, int(ref[a]))
        for a, b in zip(firsts[long], lasts[long], strict=True)
    ]


def window_starts(
    n_words: int, seq: int, bits: int, blocks: pa.ListScalar, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows inside factors, and of the others around anchors."""
    place = blocks.values.field("place").to_numpy()
    ref = blocks.values.field("ref").to_numpy()
    order = np.argsort(place)
    place, ref = place[order].astype(np.int64), ref[order]
    base = seq << bits
    inside = np.zeros(n_words + 1, np.int64)
    for a, b, _ in parse(place + base, ref, window):
        inside[a - base] += 1
        inside[b - base - window + 1] -= 1
    held = np.cumsum(inside) > 0
    at = near_anchor(n_words, place, window)
    return np.flatnonzero(held), at[~held[at]]


def _boundaries(window: int, bits: int):
    """(seq, text, blocks) -> fingerprint and place of every window around an anchor, but
    those inside factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(0).to_pylist()
            for k, text in enumerate(W.utf8(batch.column(1))):
                words = W.word_hashes(text)
                _, at = window_starts(len(words), seqs[k], bits, batch.column(2)[k], window)
                g, h = (W.grams(w, window)[at].view(np.int64) for w in (words, W.mix(words, 0xC33)))
                for a in range(0, len(at), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    columns = g[part], h[part], at[part] + (seqs[k] << bits)
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["g", "h", "place"])

    return run


def spans_of(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Spans [from, to) of words in repeated windows, which overlap or touch within a span."""
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window) + 1
    firsts = starts[np.concatenate([[0], breaks])]
    lasts = starts[np.concatenate([breaks - 1, [len(starts) - 1]])]
    return [(int(a), int(b) + window) for a, b in zip(firsts, lasts, strict=True)]


def _cut(window: int, bits: int, texts: bool):
    """(seq, text, blocks, firsts) -> repeated spans and what is left of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            seqs, firsts = batch.column(0).to_pylist(), batch.column(3)
            for k, text in enumerate(W.utf8(batch.column(1))):
                words = text_words(text)
                inside, at = window_starts(len(words), seqs[k], bits, batch.column(2)[k], window)
                new = np.asarray(firsts[k].values) if firsts[k].is_valid else np.zeros(0, np.int64)
                spans = spans_of(np.union1d(inside, np.setdiff1d(at, new)), window)
                keep, last = [], 0
                for a, b in spans:
                    keep += words[last:a]
                    last = b
                keep += words[last:]
                out.append((len(words) - len(keep), b" ".join(keep), spans))
            left = [x[1] for x in out]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in out], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in left], pa.string()),
                    pa.array([x[1].decode() if texts and x[2] else None for x in out], pa.string()),
                    pa.array(
                        [[{"start": a, "stop": b} for a, b in x[2]] for x in out],
                        pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
                    ),
                ],
                ["seq", *_PARSED_NAMES],
            )

    return run


def _number(rows: DataFrame, shelf: Shelf) -> tuple[DataFrame, int]:
    """(row, source_key, seq): the first document of each word sequence, numbered in order.

    Also the bits that a place in a document takes; the rest of 63 is for numbers.
    """
    order = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "row")
    firsts = rows.groupBy("whole_sha256").agg(F.min(F.struct(order.alias("o"), "source_key")).alias("f"))
    laid = shelf.put(
        firsts.select("f.o.id", "f.o.row", "f.source_key")
        .orderBy("id", "row")
        .withColumn("part", F.spark_partition_id())
        .withColumn("within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "laid",
    )
    sizes = sorted((r.part, r.n) for r in laid.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    upto, offsets = 0, []
    for part, n in sizes:
        offsets.append((part, upto))
        upto += n
    longest = rows.agg(F.max("n_words")).first()[0] or 1
    bits = longest.bit_length()
    if bits + upto.bit_length() > 63:
        raise ValueError("too many documents of such length for 63-bit places")
    table = rows.sparkSession.createDataFrame(offsets, "part int, offset long")
    numbered = laid.join(F.broadcast(table), "part")  # one row a partition
    return shelf.put(numbered.selectExpr("row", "source_key", "offset + within as seq"), "firsts"), bits


_PARSED_NAMES = ("n_removed", "kept_sha256", "kept_text", "factors")
_PARSED = (
    "n_removed long, kept_sha256 string, kept_text string, "
    "factors array<struct<start: long, stop: long>>"
)


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of (doc_id, text).

    With ``texts`` also ``kept_text`` (the kept words joined by one space), null where
    nothing was removed, ``factors`` (spans of words) and ``source_key`` (a hash of id and text).
    A window counts as repeated if the same words start earlier: in a row with a
    smaller doc_id, or further left in the same row.  Null ids come before
    all others; rows with equal ids follow one another as they are read.  Null, empty and blank texts have no words.  Other
    columns are ignored; an empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession, "substring")
    source = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("source_key"), "text")
    rows = shelf.put(
        source.mapInArrow(
            _scan(window),
            "doc_id long, source_key long, n_words long, whole_sha256 string, "
            "anchors array<long>, places array<int>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "rows",
    )
    firsts, bits = _number(rows.where(F.col("n_words") >= window), shelf)
    anchors = (
        rows.join(firsts.select("row", "seq"), "row")
        .select("seq", F.explode(F.arrays_zip("anchors", "places")).alias("x"))
        .select(
            F.col("x.anchors").alias("anchor"),
            (F.shiftleft("seq", bits) + F.col("x.places")).alias("own"),
        )
    )
    index = shelf.put(  # a table, so that the join below can split a hot anchor
        anchors.groupBy("anchor")
        .agg(F.min("own").alias("ref"), F.max("own").alias("last"))
        .where("ref < last")
        .drop("last"),
        "index",
    )
    mask = F.lit((1 << bits) - 1)
    blocks = shelf.put(
        anchors.join(index, "anchor")
        .groupBy(F.shiftright("own", bits).alias("seq"))
        .agg(  # of one document
            F.collect_list(F.struct(F.col("own").bitwiseAND(mask).cast("int").alias("place"), "ref")).alias("blocks")
        ),
        "blocks",
    )
    shelf.drop("index")
    wanted = firsts.join(blocks, "seq").select("seq", "source_key", "blocks")
    parsed = shelf.put(
        source.select("source_key", "text").join(wanted, "source_key").select("seq", "text", "blocks"),
        "parsed",
    )
    shelf.drop("blocks")
    first = (
        parsed.mapInArrow(_boundaries(window, bits), "g long, h long, place long")
        .groupBy("g", "h")
        .agg(F.min("place").alias("place"))
        .groupBy(F.shiftright("place", bits).alias("seq"))
        .agg(F.collect_list(F.col("place").bitwiseAND(mask)).alias("firsts"))
    )
    done = (
        parsed.join(first, "seq", "left")
        .select("seq", "text", "blocks", "firsts")
        .mapInArrow(_cut(window, bits, texts), f"seq long, {_PARSED}")
        .groupBy("seq")  # rows that repeat both id and text were parsed alike
        .agg(F.any_value(F.struct(*_PARSED_NAMES)).alias("x"))
        .join(firsts.select("seq", "row"), "seq")
        .select("row", "x.*")
    )
    copies = rows.select("doc_id", "source_key", "row", "n_words", "whole_sha256").join(
        firsts.select("row", F.lit(True).alias("is_first")), "row", "left"
    ).join(done, "row", "left")
    gone = F.col("is_first").isNull() & (F.col("n_words") >= window)
    result = copies.select(
        "doc_id",
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(gone, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop"))))
        .otherwise(F.col("factors"))
        .alias("factors"),
        "source_key",
    )
    return result if texts else result.drop("kept_text", "factors", "source_key")
