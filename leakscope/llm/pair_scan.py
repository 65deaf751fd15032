"""A max-plus scan that gives the ids of a byte-pair model, for texts cut at any place.

Two neighbouring pieces are compatible if merging their joined text in the model's order
gives the two pieces back.  The model's encoding is the only split into pieces whose
neighbours are all compatible, so it is the best split when a compatible pair weighs 0 and
any other minus infinity; no sum of scores is needed.

The state at a chunk boundary is the last piece that starts before it, which may reach
beyond.  Each chunk sees ``longest`` characters on both sides, lists the states at its two
boundaries and gives the matrix of weights from every left to every right state.  Products
of neighbouring matrices form a tree; going down again fixes the state at every boundary,
and each chunk is traced alone between its two states.

Weights are 0 or minus infinity only, so a matrix is kept as bits: (max, +) is (or, and).
No piece has U+2581 behind another character, hence nothing is carried over the start of a
word: whole words inside a chunk come from the cache of words, and the walk covers the cut
words at its ends, or all of it if no word starts there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from leakscope.llm.pieces import SPACE, TOGETHER, normalise, vocabulary

PAIRS = 200_000  # pairs of pieces whose answer a worker keeps

Node = tuple[int, int]  # start and end of a piece in its chunk


class PairScan:
    """States, matrices and traces of chunks; ``start`` finds the places where words start."""

    def __init__(self, path: str, start) -> None:
        vocab = vocabulary(path)
        self.pieces, self.beginnings = vocab.pieces, vocab.beginnings
        self.longest, self.byte_ids = vocab.longest, vocab.byte_ids
        self.start = start
        self.known: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text in the order of merges: the best score first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.pieces.get(a + b, (-np.inf,))[0] for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -np.inf:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fits(self, left: str, right: str) -> bool:
        """Whether the pieces are compatible; an empty left one asks whether the right one is a piece at all."""
        if left and right[0] == SPACE and left[-1] != SPACE:
            left = ""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= PAIRS:
                self.known = {}
            found = self.merge(left + right) == ([left, right] if left else [right])
            self.known[left, right] = found
        return found

    def ends(self, text: str, at: int) -> Iterator[int]:
        """Ends of the pieces that start at a place; a character in no piece stands alone."""
        for end in range(at + 1, min(at + self.longest, len(text)) + 1):
            piece = text[at:end]
            known = piece in self.beginnings
            if piece in self.pieces or end == at + 1:
                yield end
            if not known:
                return

    def states(self, text: str, at: int) -> list[Node]:
        """Pieces that start before a place and end there or behind it; at 0 an empty one."""
        if at == 0:
            return [(0, 0)]
        return [
            (s, e)
            for s in range(max(0, at - self.longest), at)
            for e in self.ends(text, s)
            if e >= at and self.fits("", text[s:e])
        ]

    def walk(self, text: str, first: Node, limit: int) -> dict[Node, Node | None]:
        """Pieces on ways of compatible pairs from ``first`` up to ``limit`` or beyond, each with the one before."""
        before: dict[Node, Node | None] = {first: None}
        at = {first[1]: [first]}
        for place in range(first[1], limit):
            for node in at.pop(place, ()):
                for end in self.ends(text, place):
                    if self.fits(text[node[0] : place], text[place:end]) and (place, end) not in before:
                        before[place, end] = node
                        at.setdefault(end, []).append((place, end))
            if not at:
                break
        return before

    def words(self, text: str, lo: int, hi: int) -> Node | None:
        """The first and the last place in a chunk where a word starts."""
        found = [m.start() for m in self.start.finditer(text, lo, hi)]
        return (found[0], found[-1]) if found else None

    def matrix(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Which right states follow which left ones in the chunk ``text[lo:hi]``."""
        lefts, rights = self.states(text, lo), {n: j for j, n in enumerate(self.states(text, hi))}
        out = np.zeros((len(lefts), len(rights)), bool)
        inner = self.words(text, lo, hi)
        if inner:
            tail = self.walk(text, (inner[1], inner[1]), hi)
            behind = [rights[n] for n in tail if n[1] >= hi]
        for i, left in enumerate(lefts):
            if not inner:
                for n in self.walk(text, left, hi):
                    if n[1] >= hi:
                        out[i, rights[n]] = True
            elif any(n[1] == inner[0] for n in self.walk(text, left, inner[0])):
                out[i, behind] = True
        return out

    def trace(self, text: str, lo: int, hi: int, i: int, j: int) -> tuple[list[int], str, list[int]]:
        """ids before the first word, text of the whole words, ids behind them, of the pieces that start in a chunk."""
        left, right = self.states(text, lo)[i], self.states(text, hi)[j]
        inner = self.words(text, lo, hi)
        if not inner:
            return self._ids(text, self.walk(text, left, hi), right), "", []
        head = self.walk(text, left, inner[0])
        last = next(n for n in head if n[1] == inner[0])
        tail = self.walk(text, (inner[1], inner[1]), hi)
        return self._ids(text, head, last), text[inner[0] : inner[1]], self._ids(text, tail, right)

    def _ids(self, text: str, before: dict[Node, Node | None], node: Node) -> list[int]:
        found: list[list[int]] = []
        while before[node] is not None:
            piece = text[node[0] : node[1]]
            got = self.pieces.get(piece)
            found.append([got[1]] if got else self.byte_ids[list(piece.encode())].tolist())
            node = before[node]
        return [i for part in reversed(found) for i in part]


def between(mats: list[np.ndarray]) -> list[Node]:
    """(left, right) state of every chunk: products level by level, then the states from the top down."""
    levels = [mats]
    while len(levels[-1]) > 1:
        own = levels[-1]
        levels.append([own[k] @ own[k + 1] if k + 1 < len(own) else own[k] for k in range(0, len(own), 2)])
    ends = [(0, int(np.flatnonzero(levels[-1][0][0])[0]))]
    for own in reversed(levels[:-1]):
        below = []
        for k, (left, right) in enumerate(ends):
            if 2 * k + 1 == len(own):
                below.append((left, right))
                continue
            middle = int(np.flatnonzero(own[2 * k][left] & own[2 * k + 1][:, right])[0])
            below += [(left, middle), (middle, right)]
        ends = below
    return ends


def parts_of(text: str, chunk: int, longest: int) -> list[tuple[int, int, str]]:
    """(lead, size, characters with those around them) of every chunk of a normalised text."""
    at = range(0, max(len(text), 1), chunk)
    return [
        (min(a, longest), min(chunk, len(text) - a), text[max(0, a - longest) : a + chunk + longest])
        for a in at
    ]


CHUNKS = "row long, chunk long, lead long, size long, part string"


def cut_anywhere(path: str, chunk: int):
    """(row, text) -> chunks with the characters around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = vocabulary(path).longest
        for b in batches:
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lead, size, part = zip(*parts_of(normalise(text), chunk, longest), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row] * len(part), pa.int64()),
                        pa.array(range(len(part)), pa.int64()),
                        pa.array(lead, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(part, pa.string()),
                    ],
                    ["row", "chunk", "lead", "size", "part"],
                )

    return run


MATRICES = "row long, chunk long, lefts long, rights long, bits binary"


def matrices(scan):
    """Chunks -> their matrices; ``scan`` gives the worker's PairScan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = scan()
        for b in batches:
            lead, size, part = (b.column(k).to_pylist() for k in (2, 3, 4))
            got = [pairs.matrix(t, a, a + n) for a, n, t in zip(lead, size, part, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array([m.shape[0] for m in got], pa.int64()),
                    pa.array([m.shape[1] for m in got], pa.int64()),
                    pa.array([np.packbits(m).tobytes() for m in got], pa.binary()),
                ],
                ["row", "chunk", "lefts", "rights", "bits"],
            )

    return run


def states_between(pdf: pd.DataFrame) -> pd.DataFrame:
    """One document: the states at both boundaries of every chunk."""
    pdf = pdf.sort_values("chunk")
    mats = [
        np.unpackbits(np.frombuffer(b, np.uint8), count=n * m).reshape(n, m).astype(bool)
        for n, m, b in zip(pdf["lefts"], pdf["rights"], pdf["bits"], strict=True)
    ]
    left, right = zip(*between(mats), strict=True)
    return pdf[["row", "chunk"]].assign(left_state=left, right_state=right)


def traces(scan, words):
    """Chunks with their states -> ids; ``words`` gives the worker's encoder of whole words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, encoder = scan(), words()
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                rows = zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5, 6)), strict=True)
                got = [pairs.trace(t, a, a + n, i, j) for a, n, t, i, j in rows]
                inner = encoder.encode_many([g[1] for g in got])
                ids = [
                    np.concatenate([np.array(h, np.int32), own, np.array(t, np.int32)]).tobytes()
                    for (h, _, t), own in zip(got, inner, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(ids, pa.binary())], ["row", "chunk", "ids"]
                )

    return run
