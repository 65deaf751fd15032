"""Components and whitened rows against numpy's eigenvectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.llm.queries import QUERIES
from leakscope.llm.whitening import deviations, polar, spectrum, whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, id string, x string, n string, whitened string"


def quantise(c):
    return F.floor(c * 1024).cast("long") + 100_000


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 5, 30),
        2.0 ** -np.arange(30),
        np.array([5.0] * 10 + [1.0] * 10 + [0.0] * 5),
        np.array([-3.0, -1, 0, 2, 7]),
        np.array([4.0]),
        np.array([1e6, 1 + 1e-9, 1, 1 - 1e-9]),
    ],
)
def test_spectrum(values):
    a = symmetric(values)
    e, v = spectrum(a)
    assert np.allclose(e, np.sort(values)[::-1], atol=1e-12 * np.abs(values).max())
    assert np.allclose(v.T @ v, np.eye(len(values)), atol=1e-12)
    assert np.allclose(a @ v, v * e, atol=1e-11 * np.abs(values).max())
    top, axes = spectrum(a, 3)
    assert np.allclose(top, e[:3]) and axes.shape == (len(values), min(3, len(values)))


def test_equal_values_stop():
    e, v = spectrum(np.eye(6) * 3)
    assert np.allclose(e, 3) and np.allclose(v.T @ v, np.eye(6))
    e, v = spectrum(np.zeros((4, 4)))
    assert np.allclose(e, 0) and np.allclose(v.T @ v, np.eye(4))


def test_polar_is_the_sign():
    values = np.array([3.0, 1e-6, -1e-9, -2.0])
    a = symmetric(values, 3)
    e, v = np.linalg.eigh(a)
    assert np.allclose(polar(a), (v * np.sign(e)) @ v.T, atol=1e-6)


def check(rows, got, components=8):
    """``got`` against numpy on the vectors that remain."""
    keep = [
        (i, v) for i, v, *_ in rows
        if v is not None and all(c is not None and np.isfinite(c) for c in v)
    ]
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in keep])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    white = centred @ v / np.sqrt(e)
    dev = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    assert len(got) == n
    order = sorted(range(n), key=lambda k: (keep[k][0] is not None, keep[k][0] or 0, dev[k]))
    got = sorted(got, key=lambda r: (r.id is not None, r.id or 0, r.deviation))
    found = np.array([r.whitened for r in got])
    signs = np.sign((found * white[order]).sum(axis=0))
    assert np.allclose(found * signs, white[order], atol=1e-8)
    assert [r.deviation for r in got] == [dev[k] for k in order]
    assert {r.n for r in got} == {n}
    for r in got:
        assert np.allclose(r.explained, e / np.trace(cov), rtol=1e-9)
        assert r.identity_error < 1e-9


def test_edge_rows(spark):
    rng = np.random.default_rng(1)
    scale = np.array([3.0, 2.0, 1.0, 0.5])
    rows = [(k, (rng.normal(size=4) * scale).tolist()) for k in range(60)]
    rows += [rows[0], rows[0], (None, [1.0, 2.0, 3.0, 4.0]), (7, [0.5] * 4)]
    rows += [(100, None), (101, [1.0, None, 1.0, 1.0]), (102, [float("nan"), 1.0, 1.0, 1.0])]
    rows += [(103, [float("inf"), 1.0, 1.0, 1.0]), (104, [1.0, 1.0, 1.0, float("-inf")])]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)
    check(rows, whiten(df, quantise, 3).collect(), 3)
    other = df.unionByName(spark.createDataFrame([(200, [1.0], *"abcd"), (201, [], *"abcd")], SCHEMA))
    check(rows, whiten(other, quantise, 3).collect(), 3)


def test_without_rows_or_variance(spark):
    assert whiten(spark.createDataFrame([], SCHEMA), quantise).collect() == []
    same = spark.createDataFrame([(k, [1.0, 2.0], *"abcd") for k in range(3)], SCHEMA)
    got = whiten(same, quantise).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [
        (0, [None, None], [None, None], None)
    ] * 3
    line = spark.createDataFrame([(k, [float(k), 1.0], *"abcd") for k in range(4)], SCHEMA)
    for r in whiten(line, quantise).collect():
        assert r.whitened[0] is not None and r.whitened[1] is None
        assert r.explained == pytest.approx([1.0, 0.0]) and r.identity_error < 1e-9
    none = spark.createDataFrame([(1, [], *"abcd"), (2, [], *"abcd")], SCHEMA)
    assert [(r.whitened, r.deviation) for r in whiten(none, quantise).collect()] == [([], 0)] * 2


def test_deviations_are_exact_or_null():
    x = np.array([[1 << 20, -(1 << 20)], [3, 4], [1 << 31, 1 << 31]])
    sums = np.array([5, -7], object)
    n = 1 << 10
    got = deviations(x, sums, n).to_pylist()
    want = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    assert got == [w if w < 1 << 63 else None for w in want]


def test_query_over_a_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    df = QUERIES["op13_whitening"](spark, SF)
    assert df.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
    ]
    packed = (
        df.groupBy(F.col("vec_id").alias("id"), "n", "deviation", "identity_error")
        .agg(F.array_sort(F.collect_list(F.struct("component", "whitened", "explained"))).alias("own"))
        .select("id", "n", "deviation", "identity_error", "own.whitened", "own.explained")
    )
    check([tuple(r) for r in rows], packed.collect())
