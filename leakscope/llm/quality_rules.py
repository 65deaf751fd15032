"""Quality rules by repetition coverage: characters inside repeated n-grams and lines.

Words are hashed with a rolling polynomial, windows of several lengths are hashed
from the word hashes, and equal windows of one text are found by sorting.  The
share of characters (code points in words) that lie in repeated windows of n words
is compared with a limit for each n, as is the share of characters in repeated lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leakscope.llm import words as W

# Largest accepted share of characters in windows of n words that occur twice or
# more in the text, and in lines that repeat an earlier line.
GRAM_LIMITS = {5: 0.40, 6: 0.38, 8: 0.34, 10: 0.30}
LINE_LIMIT = 0.30

BASE_WINDOW = 8
MIN_WORDS = 20
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, line_share double, "
    + ", ".join(f"gram{n}_share double" for n in GRAM_LIMITS)
)
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = 1


def repeated(words: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether it lies in an n-word window that its text has twice or more."""
    m = len(words) - n + 1
    inside = np.zeros(len(words) + 1, np.int64)
    if m > 0:
        doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        at = np.flatnonzero(doc[:m] == doc[n - 1 :])
        keys = W.mix(W.grams(words, n)[at] + doc[at] * np.uint64(0xD1B54A32D192ED03))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(inside, at[twice], 1)
        np.add.at(inside, at[twice] + n, -1)
    return np.cumsum(inside)[:-1] > 0


def dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and their code points in words."""
    seen: set[bytes] = set()
    n = chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
            chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
        elif line.strip(b" \t\v\f\r"):
            seen.add(line)
    return n, chars


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return upto[at[1:]] - upto[at[:-1]]


def _words_and_chars(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and code points of all words, words per text, symbols per text."""
    hashes, chars, counts, symbols = [], [], [], []
    pieces = [(k, p) for k, t in enumerate(texts) for p in W.slices(t)]
    if len(pieces) == len(texts):
        whole = b"\n".join(texts) + b"\n"
        heads = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        blocks = [(whole, heads)]
    else:
        blocks = [(p, np.array([0, len(p)])) for _, p in pieces]
    for block, heads in blocks:
        buf = np.frombuffer(block, np.uint8)
        starts, ends = W.bounds(buf)
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        signs = np.concatenate([[0], np.cumsum(_SYMBOL[buf])])
        hashes.append(W.hashes(buf, starts, ends))
        chars.append(points[ends] - points[starts])
        counts.append(np.diff(np.searchsorted(starts, heads)))
        symbols.append(np.diff(signs[heads]))
    n, s = np.concatenate(counts), np.concatenate(symbols)
    if len(pieces) != len(texts):
        owner = [k for k, _ in pieces]
        n = np.bincount(owner, n, len(texts)).astype(np.int64)
        s = np.bincount(owner, s, len(texts)).astype(np.int64)
    return np.concatenate(hashes), np.concatenate(chars), n, s


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All columns but doc_id for some texts."""
    words, chars, n, symbols = _words_and_chars(texts)
    lines = np.array([dup_lines(t) for t in texts], np.int64).reshape(-1, 2)
    total = _sums(chars, n)
    again = _sums(repeated(words, n, BASE_WINDOW).astype(np.int64), n)
    failed = (n < MIN_WORDS) | (100 * again > 30 * n)
    share = lambda x: x / np.maximum(total, 1)
    out = {
        "n_words": n,
        "word_chars": total,
        "n_symbols": symbols,
        "n_dup_lines": lines[:, 0],
        "n_repeat_words": again,
        "base_failed": failed,
        "kept": ~failed & (share(lines[:, 1]) <= LINE_LIMIT),
        "line_share": share(lines[:, 1]),
    }
    for size, limit in GRAM_LIMITS.items():
        covered = share(_sums(np.where(repeated(words, n, size), chars, 0), n))
        out[f"gram{size}_share"] = covered
        out["kept"] &= covered <= limit
    return out


def quality_rules(docs: DataFrame) -> DataFrame:
    """Measures and verdict of every document (doc_id, text); other columns are ignored.

    A null text has no words and fails, as does an empty one.  Repeated rows are
    judged alone, each gives a row.  An empty table gives an empty result.
    Windows are compared by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.utf8(batch.column(1))
            for lo, hi in W.groups(texts):
                got = measure(texts[lo:hi])
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(v) for v in got.values())], ["doc_id", *got]
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
