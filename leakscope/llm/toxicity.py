"""Toxicity: a counterfactual-regularised linear classifier.

Features are hashed words, word beginnings and word pairs (letters only, lower case) that
a whole text has.  In the labelled sample, every sentence that names a group is repeated with the
term swapped for another; besides the log-loss, the fit penalises the squared change of
the score under these swaps, so that naming a group does not by itself raise a score.

The fit takes at most ``SAMPLE_DOCS`` labelled documents, those with the smallest hash of
their id, ``SWAPS`` swaps of each, and the ``SELECTED`` features whose counts differ most
between the labels.  Counting runs in Spark; the driver gets only selected features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.llm import words as W

BITS = 20
STEMS = (4, 6, 7)  # bytes of a word's beginning
SAMPLE_DOCS = 20_000
SELECTED = 2048
LEAST_DOCS = 8
LEAST_Z = 4.0
SWAPS = 8
PENALTY, RIDGE = 5.0, 1e-4
STEPS = 300
# Group terms that are exchanged for one another.
TERMS = (
    "women men girls boys black white asian african european american arab jewish muslim "
    "christian hindu buddhist gay lesbian straight transgender immigrant refugee foreigner "
    "disabled deaf blind elderly young"
).split()
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True
_SENTENCE = re.compile(rb"[.!?\n]+")
_TERM = re.compile(rb"(?<![a-z\x80-\xff])(" + "|".join(TERMS).encode() + rb")(?![a-z\x80-\xff])")


def _runs(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.concatenate([[False], _LETTER[buf], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def _word_features(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and a row of hashes for each: the word and its beginnings."""
    starts, ends = _runs(buf)
    kinds = [W.hashes(buf, starts, ends)]
    for n in STEMS:
        long = np.flatnonzero(ends - starts > n)
        stem = kinds[0].copy()  # of a shorter word: the word itself
        stem[long] = W.mix(W.hashes(buf, starts[long], starts[long] + n), n)
        kinds.append(stem)
    return starts, np.stack(kinds, axis=1)


def _doc_features(words: np.ndarray) -> np.ndarray:
    whole = words[:, 0]
    pairs = W.mix(whole[:-1] * np.uint64(3) + whole[1:], 0x9A1)
    every = np.concatenate([words.ravel(), pairs])
    return np.unique((every >> np.uint64(64 - BITS)).astype(np.int32))


def features(text: bytes) -> np.ndarray:
    """Distinct features of one text of any length, in order."""
    words = []
    for part in W.slices(W.lower(text)):
        buf = np.frombuffer(part, np.uint8)
        words.append(_word_features(buf)[1])
    return _doc_features(np.concatenate(words))


def many_features(texts: list[bytes]) -> list[np.ndarray]:
    if len(texts) == 1:
        return [features(texts[0])]
    buf = np.frombuffer(W.lower(b"\n".join(texts) + b"\n"), np.uint8)
    starts, words = _word_features(buf)
    at = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    return [_doc_features(words[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def swaps(text: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lost, gained) features when a sentence of the text names another group."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for sentence in _SENTENCE.split(W.lower(text)):
        for m in _TERM.finditer(sentence):
            if len(out) == SWAPS:
                return out
            k = TERMS.index(m[1].decode())
            other = TERMS[(k + 1 + len(out) * 5) % len(TERMS)].encode()
            if other == m[1]:
                other = TERMS[(k + 1) % len(TERMS)].encode()
            old = features(sentence)
            new = features(sentence[: m.start()] + other + sentence[m.end() :])
            out.append((np.setdiff1d(old, new), np.setdiff1d(new, old)))
    return out


@dataclass
class Model:
    weights: np.ndarray  # 2 ** BITS
    base: float

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        z = np.array([float(self.weights[f].sum(dtype=np.float64)) for f in found]) + self.base
        return 1 / (1 + np.exp(-z))


def _ragged(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(r) for r in rows]
    flat = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int64)
    return np.repeat(np.arange(len(rows)), sizes), flat


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    changes: list[tuple[np.ndarray, np.ndarray]],
    penalty: float = PENALTY,
    steps: int = STEPS,
) -> Model:
    """Logistic regression with the counterfactual penalty, by Adam over all rows."""
    size = 1 << BITS
    if not rows:
        return Model(np.zeros(size, np.float32), 0.0)
    used, at = np.unique(
        np.concatenate([*rows, *(x for c in changes for x in c), np.zeros(0, np.int32)]).astype(np.int64),
        return_inverse=True,
    )
    n = sum(map(len, rows))
    doc, _ = _ragged(rows)
    col = at[:n]
    pair = np.concatenate([np.full(len(x), k) for k, c in enumerate(changes) for x in c] or [doc[:0]]).astype(np.int64)
    sign = np.concatenate([np.full(len(x), s) for c in changes for x, s in zip(c, (-1.0, 1.0), strict=True)] or [np.zeros(0)])
    pcol = at[n:]
    share = np.clip(labels.mean(), 0.001, 0.999)
    w, base = np.zeros(len(used)), float(np.log(share / (1 - share)))
    m, v, bm, bv = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(doc, w[col], len(rows)) + base
        d = (1 / (1 + np.exp(-z)) - labels) / len(rows)
        g = np.bincount(col, d[doc], len(w)) + RIDGE * w
        if len(changes):
            move = np.bincount(pair, sign * w[pcol], len(changes))
            g += penalty * np.bincount(pcol, 2 * sign * move[pair], len(w)) / len(changes)
        gb = d.sum()
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        bm += 0.1 * (gb - bm)
        bv += 0.01 * (gb * gb - bv)
        fix = (1 - 0.9**step), (1 - 0.99**step)
        w -= 0.1 * m / fix[0] / (np.sqrt(v / fix[1]) + 1e-8)
        base -= 0.1 * bm / fix[0] / (np.sqrt(bv / fix[1]) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[used] = w
    return Model(weights, float(base))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = W.utf8(b.column(2))
        for lo, hi in W.groups(texts):
            changes = [swaps(t) for t in texts[lo:hi]]
            as_list = lambda k, c=changes: pa.array(
                [[x[k].tolist() for x in row] for row in c], pa.list_(pa.list_(pa.int32()))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(lo, hi - lo),
                    b.column(1).slice(lo, hi - lo),
                    pa.array(many_features(texts[lo:hi]), pa.list_(pa.int32())),
                    as_list(0),
                    as_list(1),
                ],
                ["doc_id", "label", "found", "lost", "gained"],
            )


def toxicity_model(docs: DataFrame, labels: DataFrame, label: str = "toxic", penalty: float = PENALTY) -> Model:
    """Fit on the rows of ``labels`` (doc_id, label) that have a document.

    Rows without id or label, or with contradicting labels, teach nothing.
    """
    from leakscope.llm.shelf import Shelf

    known = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where("label = other")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).select("doc_id", "label")
    shelf = Shelf(docs.sparkSession, "toxic")
    rows = shelf.put(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # SAMPLE_DOCS rows
        .select("doc_id", "label", "text")
        .mapInArrow(
            _featurise,
            "doc_id long, label int, found array<int>, lost array<array<int>>, gained array<array<int>>",
        ),
        "sample",
    )
    n, pos = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    p = pos / n if n else 0.0
    a, k = F.col("hits"), F.col("n")
    z = F.abs(a - k * p) / F.sqrt(k * p * (1 - p) + F.lit(1e-9))
    best = (
        rows.select("label", F.explode("found").alias("f"))
        .groupBy("f")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"))
        .where((k >= LEAST_DOCS) & (z >= LEAST_Z))
        .orderBy(z.desc(), "f")
        .limit(SELECTED)
    )
    terms = [int(f) for t in TERMS for f in features(t.encode())]
    chosen_features = sorted({r.f for r in best.collect()} | set(terms))
    keep = F.array(*[F.lit(f) for f in chosen_features])
    got = rows.select(
        "doc_id",
        "label",
        F.array_intersect("found", keep).alias("found"),
        F.transform("lost", lambda x: F.array_intersect(x, keep)).alias("lost"),
        F.transform("gained", lambda x: F.array_intersect(x, keep)).alias("gained"),
    ).collect()
    got.sort(key=lambda r: (r.doc_id, sorted(r.found)))
    ints = lambda x: np.array(sorted(x), np.int32)
    changes = [(ints(a), ints(b)) for r in got for a, b in zip(r.lost, r.gained, strict=True)]
    return fit([ints(r.found) for r in got], np.array([r.label for r in got], float), changes, penalty)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text); null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = W.utf8(b.column(1))
            got = [model.scores(many_features(texts[lo:hi])) for lo, hi in W.groups(texts)]
            score = np.concatenate([np.zeros(0), *got])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score)], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
