"""SentencePiece encoding and decoding by a max-plus parallel scan.

An encoding is the split of the normalised text (a space becomes U+2581, one leads)
into pieces of the vocabulary with the largest sum of their scores; a character that
is in no piece costs ``UNKNOWN`` more than the worst piece and is written as byte
pieces.  Among equal sums the longest last piece wins at every place.

A giant document is split into chunks.  A piece may cross a boundary, so the state
there is how many characters it reaches into the next chunk.  Each chunk yields the
matrix of best scores from every state to every state; matrices are combined by
(max, +) products, an associative operation.  With the scores at its left boundary
known, each chunk tells which left state leads to each right state; following these
maps fixes the states at all boundaries, and every chunk is traced back alone.

Other documents are one chunk.  No piece has U+2581 behind another character, so their
words are encoded on their own, each distinct word once a worker.

The scores are those of the vocabulary file, read as log-probabilities.  For a file of
byte-pair merges the result is therefore its best-scored split, not the merge order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import words as W
from leakscope.llm.shelf import Shelf

GIANT = 32_768  # characters; longer documents are split
CHUNK = 1024
TOGETHER = 256  # chunks handled at once in a task
UNKNOWN = 10.0
CACHE_WORDS = 300_000
LONG_WORD = 64
SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces and scores of a model file, as lookup tables."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.GetPieceSize()
        strings = [sp.IdToPiece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.IsByte(i) or sp.IsControl(i) or sp.IsUnknown(i) or sp.IsUnused(i))]
        self.longest = max(len(strings[i]) for i in plain)
        self.unknown = min(sp.GetScore(i) for i in plain) - UNKNOWN
        self.byte_ids = np.array([sp.PieceToId(f"<0x{b:02X}>") for b in range(256)])
        self.bytes = [s.encode() for s in strings]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self.pieces = {strings[i]: (sp.GetScore(i), i) for i in plain}
        self.beginnings = {s[:k] for s in self.pieces for k in range(1, len(s) + 1)}
        self.tables = []
        for size in range(1, self.longest + 1):  # beginnings of pieces; score -inf: no piece yet
            own = [x for x in self.beginnings if len(x) == size]
            keys = self._keys(np.array([[ord(c) for c in x] for x in own], np.uint64).reshape(-1, size))
            order = np.argsort(keys)
            found = [self.pieces.get(own[k], (-np.inf, -1)) for k in order]
            scores, ids = np.array([f[0] for f in found]), np.array([f[1] for f in found], np.int64)
            self.tables.append((keys[order], scores, ids))

    @staticmethod
    def _keys(letters: np.ndarray) -> np.ndarray:
        key = np.zeros(len(letters), np.uint64)
        for k in range(letters.shape[1]):
            key = key * _BASE + letters[:, k] + np.uint64(1)
        return key

    def lattice(self, text: str, starts: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) of the piece of each length at each of the first ``starts`` places."""
        letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        score = np.full((starts, self.longest), -np.inf)
        ids = np.full((starts, self.longest), -1)
        self._look_up(letters, np.arange(starts), np.arange(starts, 0, -1) + len(letters) - starts, score, ids)
        score[np.isinf(score[:, 0]), 0] = self.unknown
        return score, ids

    def _look_up(self, letters, at, left, score, ids) -> None:
        """Fill score and id of every piece that starts at ``at``, of at most ``left`` letters."""
        key = np.zeros(len(letters), np.uint64)
        for k, (keys, scores, own) in enumerate(self.tables):
            at = at[left[at] > k]
            if not len(at) or not len(keys):
                break
            key[at] = key[at] * _BASE + letters[at + k] + np.uint64(1)
            found = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
            hit = np.flatnonzero(keys[found] == key[at])
            at, found = at[hit], found[hit]
            score[at, k], ids[at, k] = scores[found], own[found]

    def split(self, word: str) -> list[int]:
        """ids of one short text, place by place."""
        n = len(word)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for p in range(n):
            here, single = best[p], False
            for q in range(p + 1, n + 1):
                piece = word[p:q]
                if piece not in self.beginnings:
                    break
                if got := self.pieces.get(piece):
                    single |= q == p + 1
                    if here + got[0] > best[q]:
                        best[q], back[q] = here + got[0], (p, got[1])
            if not single and here + self.unknown > best[p + 1]:
                best[p + 1], back[p + 1] = here + self.unknown, (p, -1)
        ids: list[int] = []
        while n:
            p, i = back[n]
            ids += [i] if i >= 0 else self.byte_ids[list(word[p:n].encode())][::-1].tolist()
            n = p
        return ids[::-1]

    def split_many(self, words: list[str]) -> list[np.ndarray]:
        """ids of many short texts, all advancing by one place at a time."""
        size = np.array([len(w) for w in words], np.int64)
        if not len(words):
            return []
        text = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = text.astype(np.uint64) + np.uint64(1)
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        left = np.repeat(first + size, size) - np.arange(len(letters))  # letters from here on
        score = np.full((len(letters), self.longest), -np.inf)
        ids = np.full((len(letters), self.longest), -1, np.int32)
        self._look_up(letters - np.uint64(1), np.arange(len(letters)), left, score, ids)
        score[np.isinf(score[:, 0]), 0] = self.unknown
        node = first + np.arange(len(words))  # a word has one place more than letters
        best = np.full(len(letters) + len(words), -np.inf)
        best[node] = 0
        back = np.zeros(len(best), np.int64)
        longest_first = np.argsort(-size, kind="stable")
        shorter = -size[longest_first]
        for p in range(int(size.max(initial=0))):
            for k in range(self.longest):
                w = longest_first[: np.searchsorted(shorter, -(p + k))]
                if not len(w):
                    break
                new = best[node[w] + p] + score[first[w] + p, k]
                to = node[w] + p + k + 1
                better = new > best[to]
                best[to[better]], back[to[better]] = new[better], k + 1
        place, w, steps = size.copy(), np.flatnonzero(size), []
        while len(w):
            k = back[node[w] + place[w]]
            place[w] -= k
            steps.append((w, ids[first[w] + place[w], k - 1]))
            w = w[place[w] > 0]
        if not steps:
            return [np.zeros(0, np.int32) for _ in words]
        owner = np.concatenate([x for x, _ in steps[::-1]])
        found = np.concatenate([x for _, x in steps[::-1]])
        order = np.argsort(owner, kind="stable")
        parts = np.split(found[order], np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])
        for k in np.unique(owner[found < 0]):  # with bytes of unknown characters
            parts[k] = np.array(self.split(words[k]), np.int32)
        return parts

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalise(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Words:
    """ids of ordinary texts from the ids of their distinct words."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.known: dict[str, np.ndarray] = {}

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        words = [_WORD.findall(normalise(t)) for t in texts]
        every = set().union(*words)
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, new = {}, every
        short = [w for w in new if len(w) <= LONG_WORD]
        self.known.update(zip(short, self.vocab.split_many(short), strict=True))
        for w in new:
            if len(w) > LONG_WORD:
                self.known[w] = np.array(self.vocab.split(w), np.int32)
        none = [np.zeros(0, np.int32)]
        return [np.concatenate(none + [self.known[w] for w in own]) for own in words]


def _stack(vocab: Vocabulary, texts: list[str], sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lattices of several chunks; places behind a chunk's end start no piece."""
    score = np.full((len(texts), max(sizes), vocab.longest), -np.inf)
    ids = []
    for k, (t, n) in enumerate(zip(texts, sizes, strict=True)):
        score[k, :n], own = vocab.lattice(t, n)
        ids.append(own)
    return score, ids


def transfer(vocab: Vocabulary, texts: list[str], sizes: list[int]) -> np.ndarray:
    """Best score from each left state to each right state, for several chunks."""
    score, _ = _stack(vocab, texts, sizes)
    k, c, m = score.shape
    best = np.full((k, m, c + m), -np.inf)
    best[:, np.arange(m), np.arange(m)] = 0
    for p in range(c):
        after = best[:, :, p + 1 : p + 1 + m]
        width = after.shape[2]
        np.maximum(after, best[:, :, p, None] + score[:, None, p, :width], out=after)
    return np.stack([best[i, :, n : n + m] for i, n in enumerate(sizes)])


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(max, +) products of two stacks of matrices."""
    return (left[:, :, :, None] + right[:, None, :, :]).max(axis=2)


def prefixes(mats: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by combining neighbours."""
    if len(mats) == 1:
        return mats
    even = len(mats) // 2 * 2
    pairs = prefixes(product(mats[:even:2], mats[1:even:2]))
    out = np.empty_like(mats)
    out[0] = mats[0]
    out[1:even:2] = pairs
    if len(mats) > 2:
        rest = mats[2::2]
        out[2::2] = product(pairs[: len(rest)], rest)
    return out


def forward(
    vocab: Vocabulary, texts: list[str], sizes: list[int], entry: np.ndarray
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(length of the last piece, left state) of the best way to each place; ids of the lattice."""
    score, ids = _stack(vocab, texts, sizes)
    k, c, m = score.shape
    best = np.full((k, c + m), -np.inf)
    best[:, :m] = entry
    back = np.zeros((k, c + m), np.int16)
    state = np.full((k, c + m), -1, np.int16)
    state[:, :m] = np.arange(m)
    for p in range(c):
        w = min(m, c + m - p - 1)
        new = best[:, p, None] + score[:, p, :w]
        where = slice(p + 1, p + 1 + w)
        better = new > best[:, where]
        best[:, where] = np.where(better, new, best[:, where])
        back[:, where] = np.where(better, np.arange(1, w + 1), back[:, where])
        state[:, where] = np.where(better, state[:, p, None], state[:, where])
    return back, state, ids


def trace(vocab: Vocabulary, text: str, size: int, out: int, back: np.ndarray) -> np.ndarray:
    """ids of the pieces that start in a chunk, given the right state."""
    place, found = size + out, []
    while place and (n := int(back[place])):
        place -= n
        got = vocab.pieces.get(text[place : place + n])
        found.append([got[1]] if got else vocab.byte_ids[list(text[place].encode())].tolist())
    return np.array([i for part in reversed(found) for i in part], np.int32)


def encode_chunked(vocab: Vocabulary, text: str, chunk: int = CHUNK) -> np.ndarray:
    """The whole scan in one process."""
    text = normalise(text)
    at = range(0, len(text), chunk)
    parts = [text[a : a + chunk + vocab.longest - 1] for a in at]
    sizes = [min(chunk, len(text) - a) for a in at]
    if not parts:
        return np.zeros(0, np.int32)
    upto = prefixes(transfer(vocab, parts, sizes))
    entry = np.full((len(parts), vocab.longest), -np.inf)
    entry[0, 0] = 0
    entry[1:] = upto[:-1, 0]
    back, state, _ = forward(vocab, parts, sizes, entry)
    out, found = 0, []
    for k in reversed(range(len(parts))):
        found.append(trace(vocab, parts[k], sizes[k], out, back[k]))
        out = int(state[k, sizes[k] + out])
    return np.concatenate(found[::-1])


def _cut(path: str, chunk: int):
    """(row, text) -> chunks with the characters a piece may reach beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = vocabulary(path).longest - 1
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = normalise(text)
                at = range(0, len(text), chunk)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row] * len(at), pa.int64()),
                        pa.array(range(len(at)), pa.int64()),
                        pa.array([min(chunk, len(text) - a) for a in at], pa.int64()),
                        pa.array([text[a : a + chunk + reach] for a in at]),
                    ],
                    ["row", "chunk", "size", "part"],
                )

    return run


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, TOGETHER):
            yield b.slice(a, TOGETHER)


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in _few(batches):
            got = transfer(vocab, b.column(3).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([m.tobytes() for m in got], pa.binary())],
                ["row", "chunk", "matrix"],
            )

    return run


def _scan(pdf: pd.DataFrame) -> pd.DataFrame:
    """One document: the scores at every chunk's left boundary."""
    pdf = pdf.sort_values("chunk")
    mats = np.stack([np.frombuffer(m, np.float64) for m in pdf["matrix"]])
    m = int(round(mats.shape[1] ** 0.5))
    upto = prefixes(mats.reshape(-1, m, m))
    entry = np.full((len(pdf), m), -np.inf)
    entry[0, 0] = 0
    entry[1:] = upto[:-1, 0]
    return pdf[["row", "chunk"]].assign(entry=[e.tobytes() for e in entry])


def _states(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in _few(batches):
            row, chunk, size, part, entry = (c.to_pylist() for c in b.columns)
            back, state, _ = forward(vocab, part, size, np.stack([np.frombuffer(e, np.float64) for e in entry]))
            maps = [s[n : n + vocab.longest].astype(np.int16).tobytes() for s, n in zip(state, size, strict=True)]
            ways = [x.astype(np.uint8).tobytes() for x in back]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(maps, pa.binary()), pa.array(ways, pa.binary())],
                ["row", "chunk", "size", "part", "map", "back"],
            )

    return run


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """One document: the state at every chunk's right boundary."""
    pdf = pdf.sort_values("chunk")
    out, states = 0, []
    for m in reversed(pdf["map"].tolist()):
        states.append(out)
        out = int(np.frombuffer(m, np.int16)[out])
    return pdf[["row", "chunk"]].assign(out=states[::-1])


def _traces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for b in batches:
            _, _, size, part, back, out = (c.to_pylist() for c in b.columns)
            got = [
                trace(vocab, t, n, o, np.frombuffer(w, np.uint8))
                for n, t, w, o in zip(size, part, back, out, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([g.tobytes() for g in got], pa.binary())],
                ["row", "chunk", "ids"],
            )

    return run


def _join(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("chunk")
    return pd.DataFrame(
        {"row": [pdf["row"].iloc[0]], "n_chunks": [len(pdf)], "ids": [b"".join(pdf["ids"])]}
    )


def _ordinary(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(vocabulary(path))
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in W.groups([t.encode() for t in texts]):
                ids = [x.tobytes() for x in words.encode_many(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo),
                        b.column(1).slice(lo, hi - lo),
                        pa.array([1] * len(ids), pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "text", "n_chunks", "ids"],
                )

    return run


def encode_pieces(docs: DataFrame, path: str, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text, n_chunks, ids) of every row of (doc_id, text); ids are little-endian int32.

    A null text counts as empty and has no ids.  Null and repeated ids and repeated rows
    are encoded row by row.  Other columns are ignored; an empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession, "pieces")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    small = rows.where(F.length("text") <= giant).mapInArrow(
        _ordinary(path), "doc_id long, text string, n_chunks long, ids binary"
    )
    large = shelf.put(
        rows.where(F.length("text") > giant).withColumn("row", F.monotonically_increasing_id()), "large"
    )
    chunks = shelf.put(
        large.select("row", "text")
        .mapInArrow(_cut(path, chunk), "row long, chunk long, size long, part string")
        .repartition("row", "chunk"),
        "chunks",
    )
    by = ["row", "chunk"]
    entries = shelf.put(
        chunks.mapInArrow(_matrices(path), "row long, chunk long, matrix binary")
        .groupBy("row")
        .applyInPandas(_scan, "row long, chunk long, entry binary"),
        "entries",
    )
    ways = shelf.put(
        chunks.join(entries, by).mapInArrow(
            _states(path), "row long, chunk long, size long, part string, map binary, back binary"
        ),
        "ways",
    )
    outs = shelf.put(
        ways.select("row", "chunk", "map").groupBy("row").applyInPandas(_follow, "row long, chunk long, out long"),
        "outs",
    )
    traced = (
        ways.drop("map").join(outs, by).select("row", "chunk", "size", "part", "back", "out")
        .mapInArrow(_traces(path), "row long, chunk long, ids binary")
    )
    whole = traced.groupBy("row").applyInPandas(_join, "row long, n_chunks long, ids binary")
    return small.unionByName(large.join(whole, "row").select("doc_id", "text", "n_chunks", "ids"))


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``W.SLICE`` bytes of text in the second column."""
    sizes = pc.binary_length(batch.column(1)).to_pylist()
    for lo, hi in W.groups([range(n) for n in sizes]):
        yield batch.slice(lo, hi - lo)


def check_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_chunks, n_ids, ids_crc32, round_trip): whether decoding gives the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for b in slices(whole):
                _, texts, _, raw = (c.to_pylist() for c in b.columns)
                ids = [np.frombuffer(x, np.int32) for x in raw]
                same = [vocab.decode(x) == t.replace(SPACE, " ") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0),
                        b.column(2),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                        pa.array(same),
                    ],
                    ["doc_id", "n_chunks", "n_ids", "ids_crc32", "round_trip"],
                )

    return encoded.select("doc_id", "text", "n_chunks", "ids").mapInArrow(
        run, "doc_id long, n_chunks long, n_ids long, ids_crc32 long, round_trip boolean"
    )
