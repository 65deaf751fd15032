"""SentencePiece encoding by byte-pair merges, with a max-plus scan of giant documents.

The ids are those of the library's own encoder.  No piece has U+2581 behind another
character, so no merge crosses the start of a word, and words are encoded on their own,
each distinct word once a worker.

A giant document is split into chunks at any place, also within words.  ``pair_scan.py``
gives each chunk's matrix between the states at its boundaries, combines the matrices and
traces every chunk alone in many tasks; their ids are joined in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm.pair_scan import (
    CHUNKS,
    MATRICES,
    PairScan,
    between,
    cut_anywhere,
    matrices,
    parts_of,
    states_between,
    traces,
)
from leakscope.llm.pieces import (
    _WORD,
    CACHE_WORDS,
    CHUNK,
    GIANT,
    LONG_WORD,
    SPACE,
    _join,
    normalise,
    slices,
)
from leakscope.llm.shelf import Shelf

_START = re.compile(f"(?<!{SPACE}){SPACE}")


class MergedWords:
    """ids of normalised texts from the ids of their distinct words."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.space = self.library.PieceToId(SPACE)
        pieces = map(self.library.IdToPiece, range(self.library.GetPieceSize()))
        if self.space == self.library.unk_id() or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError(f"words are not independent in {path}")
        self.known: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """The library leads with U+2581 by itself, except in an empty text."""
        found = self.library.encode([w[1:] for w in words], out_type=int, num_threads=1)
        return {
            w: np.array(ids or [self.space], np.int32).tobytes()
            for w, ids in zip(words, found, strict=True)
        }

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        words = [_WORD.findall(t) for t in texts]
        every = set().union(*words)
        short = {w for w in every if len(w) <= LONG_WORD}
        new = short.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, short
        self.known.update(self._encode(list(new)))
        long = self._encode(list(every - short))
        self.known.update(long)
        found = [np.frombuffer(b"".join(map(self.known.__getitem__, own)), np.int32) for own in words]
        for w in long:
            del self.known[w]
        return found


@lru_cache(maxsize=2)
def merged_words(path: str) -> MergedWords:
    return MergedWords(path)


@lru_cache(maxsize=2)
def pair_scan(path: str) -> PairScan:
    return PairScan(path, _START)


def encode_chunked(path: str, text: str, chunk: int = CHUNK) -> list[int]:
    """The whole scan of one text in one process."""
    scan, words = pair_scan(path), merged_words(path)
    parts = parts_of(normalise(text), chunk, scan.longest)
    ends = between([scan.matrix(t, a, a + n) for a, n, t in parts])
    found: list[int] = []
    for (a, n, t), (i, j) in zip(parts, ends, strict=True):
        head, inner, tail = scan.trace(t, a, a + n, i, j)
        found += [*head, *words.encode_many([inner])[0].tolist(), *tail]
    return found


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = merged_words(path)
        for b in batches:
            for part in slices(b):
                ids = words.encode_many([normalise(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([1] * len(ids), pa.int64()),
                        pa.array([x.tobytes() for x in ids], pa.binary()),
                    ],
                    ["doc_id", "text", "n_chunks", "ids"],
                )

    return run


def encode_merges(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text, n_chunks, ids) of every row of (doc_id, text); ids are little-endian int32.

    A null text counts as empty and has no ids.  Null and repeated ids and repeated rows
    are encoded row by row.  Other columns are ignored; an empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession, "merges")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    small = rows.where(F.length("text") <= giant).mapInArrow(
        _whole(path), "doc_id long, text string, n_chunks long, ids binary"
    )
    large = shelf.put(
        rows.where(F.length("text") > giant).withColumn("row", F.monotonically_increasing_id()), "large"
    )
    chunks = shelf.put(
        large.select("row", "text").mapInArrow(cut_anywhere(path, chunk), CHUNKS).repartition("row", "chunk"),
        "chunks",
    )
    scan, words = partial(pair_scan, path), partial(merged_words, path)
    ends = shelf.put(
        chunks.mapInArrow(matrices(scan), MATRICES)
        .groupBy("row")
        .applyInPandas(states_between, "row long, chunk long, left_state long, right_state long"),
        "ends",
    )
    # The file of states is far smaller than its rows in memory, so its size must not decide a broadcast.
    parts = chunks.join(ends.hint("merge"), ["row", "chunk"]).mapInArrow(
        traces(scan, words), "row long, chunk long, ids binary"
    )
    whole = parts.groupBy("row").applyInPandas(_join, "row long, n_chunks long, ids binary")
    return small.unionByName(large.join(whole, "row").select("doc_id", "text", "n_chunks", "ids"))
