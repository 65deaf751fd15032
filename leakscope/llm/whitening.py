"""Whitening of embeddings, with components by QDWH spectral divide and conquer.

1. One pass gives the number of vectors and the sums of each dimension; a second one gives
   the covariance of the centred vectors.  Tasks send d x d sums, which are added up by row.
2. The driver sees the d x d covariance only.  The polar factor U of ``A - s I``, found by
   dynamically weighted Halley steps on QR factors, is 1 on eigenvectors above s and -1 below:
   ``(I + U) / 2`` projects on an invariant subspace.  Bases of it and of its complement
   split the matrix in two smaller ones, which are split again until single components
   remain.  Parts below the components asked for are not split further.
3. Components and scales, at most d x components numbers, are broadcast; each task whitens
   its vectors.  The whitened rows are written once, and their covariance is measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.llm.shelf import Shelf

EPS = np.finfo(float).eps
ROWS = 1 << 14  # vectors handled at once


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS  # below the smallest singular value of x, or it counts as zero
    for _ in range(60):
        root = np.cbrt(4 * (1 - low**2) / low**4) if low < 1 else 0.0
        tail = 8 - 4 * root + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + root))
        wa = np.sqrt(1 + root) + np.sqrt(max(tail, 0.0)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(n)]))
        fresh = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        fresh = (fresh + fresh.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        moved, x = np.linalg.norm(fresh - x), fresh
        if moved < 10 * EPS * np.sqrt(n) and 1 - low < 10 * EPS:
            break
    return x


def _bases(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the range of a projector and of its complement."""
    order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    basis = projector[:, order[:1]] / np.linalg.norm(projector[:, order[0]])
    for _ in range(rank - 1):  # the column that lies farthest outside so far
        rest = projector - basis @ (basis.T @ projector)
        new = rest[:, [int(np.argmax(np.linalg.norm(rest, axis=0)))]]
        new -= basis @ (basis.T @ new)
        basis = np.hstack([basis, new / np.linalg.norm(new)])
    basis = projector @ basis  # one subspace step, then orthonormal again
    full, _ = np.linalg.qr(np.hstack([basis, np.eye(len(projector))]))
    return full[:, :rank], full[:, rank : len(projector)]


def spectrum(matrix: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors."""
    matrix = (matrix + matrix.T) / 2
    wanted = len(matrix) if wanted is None else min(wanted, len(matrix))
    scale = np.linalg.norm(matrix)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    waiting = [(matrix, np.eye(len(matrix)))]  # the part with the largest eigenvalues last
    while waiting and len(values) < wanted:
        a, basis = waiting.pop()
        n = len(a)
        mean = np.trace(a) / n
        if n == 1 or np.linalg.norm(a - mean * np.eye(n)) <= n * EPS * scale:
            values += list(np.diag(a))
            vectors += list(basis.T)
            continue
        halves = _split(a, float(np.median(np.diag(a)))) or _split(a, float(mean))
        if halves is None:  # equal to rounding
            values += list(np.diag(a))
            vectors += list(basis.T)
            continue
        upper, lower = halves
        waiting.append((_restrict(a, lower), basis @ lower))
        waiting.append((_restrict(a, upper), basis @ upper))
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    return np.array(values)[order], np.array(vectors)[order].T


def _restrict(a: np.ndarray, basis: np.ndarray) -> np.ndarray:
    inner = basis.T @ a @ basis
    return (inner + inner.T) / 2


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the eigenspaces above and below the shift; None if one of them is empty."""
    n = len(a)
    moved = a - shift * np.eye(n)
    if np.linalg.norm(moved) == 0:
        return None
    projector = (polar(moved) + np.eye(n)) / 2
    rank = int(np.rint(np.trace(projector)))
    return _bases(projector, rank) if 0 < rank < n else None


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _summed(rows: DataFrame, dims: int, centre: np.ndarray) -> np.ndarray:
    """Sums of products of the centred vectors: a dims x dims matrix.

    Each task sends one row for each row of its matrix; these are added up in tasks of
    their own, so the driver gets dims x dims numbers.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = _matrix(batch.column(0).slice(first, ROWS), dims) - centre
                total += part.T @ part
        yield _lines(np.arange(dims), total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, line in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), dims), strict=True):
                sums[k] = sums.get(k, 0) + line
        if sums:
            yield _lines(np.array(list(sums)), np.array(list(sums.values())))

    kind = "k long, line array<double>"
    lines = rows.mapInArrow(products, kind).repartition("k").mapInArrow(added, kind)
    total = np.zeros((dims, dims))
    for k, line in lines.collect():
        total[k] = line
    return total


def _lines(keys: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(lines) + 1) * lines.shape[1], pa.int32())
    values = pa.ListArray.from_arrays(offsets, pa.array(lines.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), values], ["k", "line"])


def _totals(rows: DataFrame, column: str, dims: int) -> list:
    """Sums of each dimension, as Python numbers."""
    if not dims:
        return []
    got = rows.agg(*[F.sum(F.col(column)[k]).alias(f"s{k}") for k in range(dims)]).first()
    return list(got)


def finite_vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, entries) of vectors without null, NaN or infinite entries, as doubles."""
    entries = F.col(vector_column).cast("array<double>")
    fine = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return table.where(F.col(vector_column).isNotNull() & fine).select(
        F.col(id_column).alias("id"), entries.alias("entries")
    )


def whiten(
    table: DataFrame,
    quantise: Callable[[Column], Column],
    components: int = 8,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error) for every vector that remains.

    Vectors that are null or have null, NaN or infinite entries are left out.  ``quantise``
    makes a whole number (long) of an entry.  ``whitened`` and ``explained`` are arrays of at
    most ``components`` numbers by falling eigenvalue.  ``deviation`` is the exact sum of
    (n x - S)^2 over the dimensions; null beyond the range of a long.  Where the covariance
    has lower rank, a component without variance has null in ``whitened``, and ``explained``
    is null if there is no variance at all.  ``identity_error`` is measured on the whitened
    rows, over the components with variance; null without any.

    Repeated rows count as often as they occur, null ids stay null, tied eigenvalues give
    any basis of their space.  All vectors must have one length: those of another length
    than the most frequent one (the longest of several) are left out, empty ones give
    no components.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = table.sparkSession
    shelf = Shelf(spark, "whiten")
    finite = finite_vectors(table, id_column, vector_column)
    sizes = finite.groupBy(F.size("entries").alias("dims")).count()
    common = sizes.orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims, n = (common[0][0], common[0][1]) if common else (0, 0)
    numbers = finite.where(F.size("entries") == dims).select(
        "id", F.transform("entries", quantise).alias("x")
    )
    sums = [int(s or 0) for s in _totals(numbers, "x", dims)]
    mean = np.array([s / n for s in sums]) if n else np.zeros(dims)
    cov = _summed(numbers.select("x"), dims, mean) / n if n and dims else np.zeros((dims, dims))
    e, axes = spectrum(cov, components) if dims else (np.zeros(0), np.zeros((0, 0)))
    has = e > dims * EPS * max(e[0], 0.0) if len(e) else np.zeros(0, bool)
    trace = float(np.trace(cov))
    scales = np.divide(1.0, np.sqrt(np.maximum(e, 0)), out=np.full(len(e), np.nan), where=has)
    sent = spark.sparkContext.broadcast((mean, axes * scales, np.array(sums, object), n))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, scaled, totals, count = sent.value
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                x = _matrix(part.column(1), dims)
                rows = _lines(np.zeros(len(x)), (x - centre) @ scaled)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), deviations(x, totals, count), rows.column(1)],
                    ["id", "deviation", "whitened"],
                )

    kind = numbers.schema["id"].dataType.simpleString()
    rows = shelf.put(
        numbers.mapInArrow(project, f"id {kind}, deviation long, whitened array<double>"), "whitened"
    )
    kept = [int(k) for k in np.flatnonzero(has)]
    error = None
    if kept and n:
        picked = rows.select(F.array(*[F.col("whitened")[k] for k in kept]).alias("w"))
        centre = np.array(_totals(picked, "w", len(kept))) / n
        error = float(np.abs(_summed(picked, len(kept), centre) / n - np.eye(len(kept))).max())
    shares = [float(v) / trace if trace > 0 else None for v in e]
    return rows.select(
        "id",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.transform("whitened", lambda w: F.nullif(w, F.lit(float("nan")))).alias("whitened"),
        F.array(*[F.lit(s).cast("double") for s in shares]).cast("array<double>").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def deviations(x: np.ndarray, sums: np.ndarray, n: int) -> pa.Array:
    """Exact sums of (n x - S)^2 of each row of longs; null where a long cannot hold them."""
    rough = np.square(x * float(n) - sums.astype(float)).sum(axis=1) if len(sums) else np.zeros(len(x))
    wrapped = np.array([int(s) % (1 << 64) for s in sums], np.uint64)
    # Arithmetic modulo 2^64 is exact for results that fit.
    part = x.astype(np.uint64) * np.uint64(n % (1 << 64)) - wrapped
    exact = (part * part).sum(axis=1, dtype=np.uint64)
    fits = (rough < 0.999 * 2.0**63) | ((rough < 1.001 * 2.0**63) & (exact < np.uint64(1 << 63)))
    return pa.array(exact.view(np.int64), pa.int64(), mask=~fits)
