"""Words of whole texts as numpy arrays of positions and 64-bit hashes.

A word is a run of bytes other than space and \\x09-\\x0D.  Texts are handled in
slices that end at white space, so that the arrays held at once stay near
``SLICE`` bytes times a small factor, however long a text is; what remains per
text is eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SPACES = b" \t\n\v\f\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        tail = np.full(max(n, 256), _BASE, np.uint64)
        tail[0] = 1
        _powers = np.cumprod(tail)
    return _powers


def lower(text: bytes) -> bytes:
    """A-Z to a-z; other bytes stay."""
    return text.translate(_LOWER)


def slices(text: bytes) -> Iterator[bytes]:
    """Cut at white space into parts of about SLICE bytes; longer words stay whole."""
    at = 0
    while len(text) - at > SLICE:
        cut = max(text.rfind(bytes([s]), at, at + SLICE) for s in _SPACES)
        if cut <= at:
            later = [p for s in _SPACES if (p := text.find(bytes([s]), at + SLICE)) > 0]
            cut = min(later, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in an array of bytes."""
    inside = np.concatenate([[False], ~_WHITE[buf], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    within = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    letters = buf[np.repeat(starts, sizes) + within].astype(np.uint64) + np.uint64(1)
    terms = letters * power(int(sizes.max()))[within]
    return mix(np.add.reduceat(terms, first) + sizes.astype(np.uint64) * _BASE)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of all words of one text, in order."""
    parts = []
    for part in slices(text):
        buf = np.frombuffer(part, np.uint8)
        parts.append(hashes(buf, *bounds(buf)))
    return np.concatenate(parts)


def groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about SLICE bytes together."""
    return ranges(map(len, texts))


def ranges(sizes: Iterable[int]) -> Iterator[tuple[int, int]]:
    """The same for texts of these numbers of bytes."""
    first = size = last = 0
    for k, own in enumerate(sizes):
        if size and size + own > SLICE:
            yield first, k
            first, size = k, 0
        size += own + 1
        last = k + 1
    if first < last:
        yield first, last


def many_word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts in one array, and the number of words of each."""
    if len(texts) == 1:
        got = word_hashes(texts[0])
        return got, np.array([len(got)])
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = bounds(buf)
    heads = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return hashes(buf, starts, ends), np.diff(np.searchsorted(starts, heads))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (without those near the end)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:m].copy()
    for k in range(1, n):
        acc *= _BASE
        acc += words[k : k + m]
    return mix(acc, n)


def utf8(column) -> list[bytes]:
    """The texts of an Arrow column as bytes; null becomes empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
