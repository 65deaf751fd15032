"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks of 16 bytes (one
every 4 bytes) that cover the whole document, each filter keeps its largest answer
(max pooling), and a logistic unit makes one probability of them.  Long documents
pass through in pieces whose maxima are combined, so memory does not grow with a text.

The model is fitted on the driver from a bounded sample of labelled documents, each
with its whole text.  Scores always read whole texts of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from leakscope.llm import words as W
from leakscope.llm.shelf import Shelf

STRIDE, TAPS = 4, 4  # a chunk is STRIDE * TAPS bytes
DIMS, FILTERS = 8, 32
# The fit takes labelled documents in order of a hash of their id, up to so many, and so many
# bytes of text in all; longer texts than SAMPLE_TEXT are not among them.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TEXT = 8000, 48 << 20, 4 << 20
STEPS, BATCH, RATE = 400, 64, 0.01
PIECE = 1 << 20
# Chunks that are embedded at once; what follows the last whole block belongs to it.  BLAS rounds
# the rows of such blocks as it does in one product: it takes them by twelve or sixteen.
BLOCK = 3 << 12


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # TAPS x (STRIDE * DIMS) x FILTERS
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray

    @staticmethod
    def fresh(seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        normal = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        return Network(
            normal(256, DIMS, scale=0.5),
            normal(TAPS, STRIDE * DIMS, FILTERS, scale=0.15),
            np.zeros(FILTERS, np.float32),
            normal(FILTERS, scale=0.1),
            np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.base]


def lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts side by side with zero bytes between, and [first, last) chunk of each."""
    pad, spans, at, out = bytes(STRIDE * TAPS), [], 0, []
    for t in texts:
        n = -(-max(len(t), 1) // STRIDE)
        out += [t, pad[: n * STRIDE - len(t)], pad[: STRIDE * (TAPS - 1)]]
        spans += [at, at + n]
        at += n + TAPS - 1
    return np.frombuffer(b"".join(out), np.uint8), np.array(spans)


def responses(net: Network, buf: np.ndarray) -> np.ndarray:
    """Answers of all filters at all chunks."""
    letters = buf.reshape(-1, STRIDE)
    n = len(letters) - TAPS + 1
    y = np.empty((n, FILTERS), np.result_type(net.embed, net.filters))
    cuts = [*range(0, max(n - BLOCK, 0) + 1, BLOCK), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        x = net.embed[letters[a : b + TAPS - 1]].reshape(-1, STRIDE * DIMS)
        y[a:b] = x[: b - a] @ net.filters[0]
        for k in range(1, TAPS):
            y[a:b] += x[k : k + b - a] @ net.filters[k]
    return y


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    buf, spans = lay(texts)
    y = responses(net, buf)
    if spans[-1] == len(y):
        return np.maximum.reduceat(y, spans[:-1], axis=0)[::2]
    return np.maximum.reduceat(y, spans, axis=0)[::2]


def _long(net: Network, text: bytes) -> np.ndarray:
    """Pool one text piece by piece; a piece reads on so far as its own last chunk reaches."""
    best = []
    for a in range(0, max(len(text), 1), PIECE):
        buf, spans = lay([text[a : a + PIECE + STRIDE * (TAPS - 1)]])
        best.append(responses(net, buf)[: min(spans[1], PIECE // STRIDE)].max(axis=0))
    return np.max(best, axis=0)


def _largest(net: Network, texts: list[bytes]) -> np.ndarray:
    return pooled(net, texts) if len(texts) > 1 else _long(net, texts[0])[None]


def _chances(net: Network, best: list[np.ndarray]) -> np.ndarray:
    z = np.maximum(np.concatenate(best) + net.bias, 0) @ net.out + net.base
    return 1 / (1 + np.exp(-z.astype(np.float64)))


def scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """One probability for each text."""
    return _chances(net, [_largest(net, texts[lo:hi]) for lo, hi in W.groups(texts)])


def column_scores(net: Network, column: pa.Array) -> np.ndarray:
    """The same for an Arrow column, of which one group at once becomes Python bytes."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    best = [_largest(net, W.utf8(column.slice(lo, hi - lo))) for lo, hi in W.ranges(sizes)]
    return _chances(net, best)


def _gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    buf, spans = lay(texts)
    y = responses(net, buf)
    top = np.array([a + y[a:b].argmax(axis=0) for a, b in spans.reshape(-1, 2)])
    best = np.take_along_axis(y, top, axis=0) + net.bias
    h = np.maximum(best, 0)
    p = 1 / (1 + np.exp(-(h @ net.out + net.base)))
    d = ((p - labels) / len(labels)).astype(np.float32)
    back = np.outer(d, net.out) * (best > 0)
    g_filters = np.zeros_like(net.filters)
    g_embed = np.zeros_like(net.embed)
    x = net.embed[buf].reshape(-1, STRIDE * DIMS)
    letters = buf.reshape(-1, STRIDE)
    for k in range(TAPS):
        rows = top + k
        g_filters[k] = np.einsum("df,dfi->if", back, x[rows])
        np.add.at(
            g_embed,
            letters[rows],
            (back[..., None] * net.filters[k].T[None]).reshape(*top.shape, STRIDE, DIMS),
        )
    return [g_embed, g_filters, back.sum(axis=0), h.T @ d, d.sum(keepdims=True)]


def fit(texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on batches drawn in a fixed order; without rows every score is one half."""
    net = Network.fresh(seed)
    if not texts:
        for part in net.parts():
            part[...] = 0
        return net
    share = np.clip(labels.mean(), 0.01, 0.99)
    net.base[:] = np.log(share / (1 - share))
    first = [np.zeros_like(p) for p in net.parts()]
    second = [np.zeros_like(p) for p in net.parts()]
    rng, order = np.random.default_rng(seed), np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(texts))])
        now, order = order[:BATCH], order[BATCH:]
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        grads = _gradients(net, [texts[i] for i in now], labels[now])
        for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def sample(docs: DataFrame, labels: DataFrame, label: str) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of labelled documents, within the three bounds above.

    Rows without id or label, or with contradicting labels, teach nothing.  Rows that
    repeat id and text count once.
    """
    shelf = Shelf(docs.sparkSession, "sample")
    known = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(label).alias("label"), F.max(label).alias("other"))
        .where("label = other")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).select("doc_id", "label")
    text = F.coalesce("text", F.lit(""))
    rows = shelf.put(
        docs.select("doc_id", text.cast("binary").alias("text"), F.xxhash64("doc_id").alias("place"))
        .join(F.broadcast(chosen), "doc_id")  # SAMPLE_DOCS rows
        .withColumns({"own": F.xxhash64("doc_id", "text"), "size": F.octet_length("text")})
        .where(F.col("size") <= SAMPLE_TEXT)
        .dropDuplicates(["doc_id", "own"]),
        "rows",
    )
    key = ["place", "doc_id", "own"]
    sizes = rows.select(*key, "size").orderBy(*key).limit(SAMPLE_DOCS).collect()
    upto = np.searchsorted(np.cumsum([r.size for r in sizes]), SAMPLE_BYTES, side="right")
    if not upto:
        return [], np.zeros(0, np.float32)
    last = sizes[int(upto) - 1]
    taken = F.struct(*key) <= F.struct(*[F.lit(last[k]).alias(k) for k in key])
    got = sorted(rows.where(taken).select("doc_id", "label", "text").collect(), key=lambda r: (r.doc_id, bytes(r.text)))
    return [bytes(r.text) for r in got], np.array([r.label for r in got], np.float32)


def with_quality(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """All columns of ``docs`` (text among them) and the score of every row in column ``name``.

    A null text counts as empty.  ``docs`` must not have a column of that name.
    """
    if name in docs.columns:
        raise ValueError(f"column {name} is there already")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = column_scores(net, b.column(at)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_quality(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, text).

    Rows that repeat a text share its score; null ids stay; an empty table gives an empty result.
    """
    return with_quality(docs.select("doc_id", "text"), net).select("doc_id", "score")


def quality_network(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    """Fit on the rows of ``labels`` (doc_id, label) that have a document."""
    return fit(*sample(docs, labels.withColumn(label, F.col(label).cast("int")), label))
