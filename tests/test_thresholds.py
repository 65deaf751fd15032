"""Threshold search against the plain definition."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leakscope.operators import ordering, pyramid
from leakscope.operators import thresholds as T
from leakscope.session import settle


def candidates(x, y):
    """Sorted thresholds between neighbours of different labels, one beyond each end if none."""
    table = pd.DataFrame({"x": x, "y": y}).sort_values(["x", "y"]).to_numpy(float)
    middle = table[:-1, 0] + np.diff(table[:, 0]) / 2
    found = np.unique(np.where(np.diff(table[:, 1]) != 0, middle, np.nan))
    found = found[~np.isnan(found)]
    return found if len(found) else np.array([table[0, 0] - 0.1, table[-1, 0] + 0.1])


def best(x, y):
    """Accuracies of all thresholds at once; argmax takes the lowest of several."""
    t = candidates(x, y)
    right = ((x[:, None] >= t) == y[:, None].astype(bool)).mean(axis=0)
    return right.max(), t[right.argmax()]


def best2(a, b, y):
    ta, tb = candidates(a, y), candidates(b, y)
    fires = (a[:, None, None] < ta[:, None]) | (b[:, None, None] > tb)
    right = (fires == y[:, None, None].astype(bool)).mean(axis=0)
    i, j = np.unravel_index(right.argmax(), right.shape)
    return right[i, j], ta[i], tb[j]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 240
    pdf = pd.DataFrame(
        {
            "ID": [str(i) for i in range(n)],
            "g": rng.integers(0, 2, n),
            "a": np.round(rng.normal(size=n), 1),
            "b": np.round(rng.normal(size=n), 1),
            "y": rng.integers(0, 2, n),
        }
    )
    folded = settle(T.stratified_folds(spark.createDataFrame(pdf), 5, 42, "y"))
    return folded, folded.toPandas()


@pytest.fixture
def many_pieces(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.set(key, "true")


def check_cv(folded, pdf):
    cv = T.cv_threshold(folded, "a", "y", 5, ["g"]).toPandas()
    assert len(cv) == 12
    for r in cv.itertuples():
        mine = pdf[pdf.g == r.g]
        train = mine[mine.fold != r.fold]
        acc, t = best(train.a.to_numpy(), train.y.to_numpy())
        assert r.train_acc == pytest.approx(acc) and r.t == pytest.approx(t)
        if r.fold >= 0:
            test = mine[mine.fold == r.fold]
            assert r.test_acc == pytest.approx(np.mean((test.a >= t) == test.y))


def test_folds_are_even(data):
    sizes = data[1].groupby(["y", "fold"]).size().unstack()
    assert (sizes.max(axis=1) - sizes.min(axis=1) <= 1).all()


def test_cv_threshold(data):
    check_cv(*data)


def test_cv_threshold_over_pieces(data, many_pieces):
    check_cv(*data)


@pytest.mark.parametrize("side", [pyramid.SIDE, 4])
def test_best_pair(data, side, monkeypatch):
    monkeypatch.setattr(pyramid, "SIDE", side)
    folded, pdf = data
    got = T.best_pair(folded, "a", "b", "y", ["g"]).toPandas()
    for r in got.itertuples():
        mine = pdf[pdf.g == r.g]
        acc, ta, tb = best2(mine.a.to_numpy(), mine.b.to_numpy(), mine.y.to_numpy())
        assert (r.acc, r.ta, r.tb) == pytest.approx((acc, ta, tb))


NULL_PAIRS = {
    "one side": [(1.0, None, 1), (2.0, 0.5, 0), (None, 0.7, 1), (3.0, None, 0), (None, 0.1, 0)],
    "both": [(None, None, 1), (None, None, 0), (1.0, 2.0, 0), (0.5, 3.0, 1), (float("nan"), 9.0, 1)],
    "no a": [(None, 1.0, 0), (None, 2.0, 1), (None, 3.0, 1)],
    "nothing": [(None, None, 1), (None, None, 0), (None, None, 0)],
    "ties": [(1.0, 1.0, k % 2) for k in range(20)] + [(None, 1.0, 1)] * 3,
}


@pytest.mark.parametrize("side", [pyramid.SIDE, 2])
def test_best_pair_counts_nulls_as_not_firing(spark, side, monkeypatch):
    monkeypatch.setattr(pyramid, "SIDE", side)
    rows = [(g, *r) for g, own in NULL_PAIRS.items() for r in own]
    df = spark.createDataFrame(rows, "g string, a double, b double, y int").repartition(4)
    got = {r["g"]: r for r in T.best_pair(df, "a", "b", "y", ["g"]).collect()}
    assert set(got) == set(NULL_PAIRS)
    for g, own in NULL_PAIRS.items():

        def right(ta, tb, own=own):
            below = lambda v, t: v is not None and t is not None and v < t
            above = lambda v, t: v is not None and t is not None and v > t
            return sum((below(a, ta) or above(b, tb)) == bool(y) for a, b, y in own) / len(own)

        assert right(got[g]["ta"], got[g]["tb"]) == pytest.approx(got[g]["acc"])
        lists = []
        for k in (0, 1):
            known = [(r[k], r[2]) for r in own if r[k] is not None and r[k] == r[k]]
            x, y = (np.array(c, float) for c in zip(*known, strict=True)) if known else ([], [])
            lists.append(candidates(x, y) if known else [None])
        best = max(right(a, b) for a, b in itertools.product(*lists))
        assert got[g]["acc"] == pytest.approx(best)
    assert got["nothing"]["ta"] is None and got["nothing"]["tb"] is None and got["no a"]["ta"] is None


@pytest.mark.parametrize("side", [2, 8])
def test_best_corner_of_ties_and_noise(spark, side):
    """Every corner by sums over the grid; groups of unequal size, plateaus and no cells."""
    rng = np.random.default_rng(side)
    cells, sizes, want = [], [], {}
    for g, (na, nb, n, high) in enumerate(
        [(1, 1, 1, 1), (30, 7, 80, 1), (7, 30, 80, 3), (40, 40, 300, 2), (5, 5, 0, 1), (64, 64, 500, 1)]
    ):
        grid = np.zeros((na + 1, nb), int)
        for _ in range(n):
            grid[rng.integers(1, na + 1), rng.integers(nb)] += rng.choice([-high, -1, 1, high])
        own = [(g, int(p), int(q), int(grid[p, q])) for p, q in np.argwhere(grid)]
        cells += own
        sizes.append((g, na, nb))
        gain = np.array([[grid[i + 1 :, : j + 1].sum() for j in range(nb)] for i in range(na)])
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        want[g] = (int(gain.max()), int(i), int(j))
    df = spark.createDataFrame(cells, "g long, ia long, ib long, w long").repartition(3)
    got = pyramid.best_corner(df, spark.createDataFrame(sizes, "g long, na long, nb long"), side)
    assert {r.g: (r.gain, r.i, r.j) for r in got.collect()} == want


def test_one_class_falls_outside_the_range(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "ID string, x double, y int")
    assert sorted(r[0] for r in T.candidate_thresholds(df, "x", "y").collect()) == [0.9, 2.1]
    row = T.best_threshold(df, "x", "y").first()
    assert row["t"] == 0.9 and row["acc"] == 1.0


def test_null_and_nan_features_are_predicted_zero(spark):
    df = spark.createDataFrame(
        [("a", None, 0), ("b", float("nan"), 1), ("c", 1.0, 0), ("d", 3.0, 1)],
        "ID string, x double, y int",
    )
    row = T.best_threshold(df, "x", "y").first()
    assert row["t"] == 2.0 and row["acc"] == 0.75
    assert T.threshold_accuracy(df, "x", "y", 2.0).first()["acc"] == 0.75


def test_strictness_matters_at_the_threshold(spark):
    df = spark.createDataFrame([("a", 0.0, 1), ("b", 0.0, 0)], "ID string, x double, y int")
    loose = T.threshold_accuracy(df, "x", "y", 0.0).first()["acc"]
    strict = T.threshold_accuracy(df, "x", "y", 0.0, strict=True).first()["acc"]
    assert loose == strict == 0.5


def test_adjacent_doubles(spark):
    low = 1.0
    high = np.nextafter(low, 2)
    df = spark.createDataFrame([("a", low, 0), ("b", float(high), 1)], "ID string, x double, y int")
    row = T.best_threshold(df, "x", "y").first()
    assert row["acc"] == best(np.array([low, high]), np.array([0, 1]))[0]


def test_split_is_a_partition_with_shared_sizes(spark):
    rows = [(str(i), "abc"[i % 3] if i % 7 else None, i % 2) for i in range(101)]
    df = spark.createDataFrame(rows, "ID string, CATEGORY string, LABEL_BINARY int")
    out = T.stratified_split(df, 0.3, 42).toPandas()
    assert len(out) == 101 and out.ID.is_unique
    assert out.is_test.sum() == 31
    share = out.groupby(["CATEGORY", "LABEL_BINARY"], dropna=False).is_test.agg(["sum", "count"])
    assert ((share["sum"] - share["count"] * 31 / 101).abs() < 1).all()


def test_valid_items(spark):
    df = spark.createDataFrame([("a", None), ("b", "x")], "ID string, CATEGORY string")
    assert T.valid_items(df, ["ID", "CATEGORY"]).count() == 1
    with pytest.raises(ValueError):
        T.valid_items(df.where("ID = 'a'"), ["ID", "CATEGORY"])


def test_exact_percentiles(spark, many_pieces):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 200), "v": np.round(rng.normal(size=200), 1)})
    got = ordering.exact_percentiles(
        spark.createDataFrame(pdf), ["g"], "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}
    ).toPandas()
    for r in got.itertuples():
        want = np.percentile(pdf[pdf.g == r.g].v, [25, 50, 75])
        assert (r.q1, r.med, r.q3) == pytest.approx(tuple(want))


def test_top_k_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("if(id < 4000, 'hot', 'cold') as g", "5000 - id as v")
    got = ordering.top_k(df, ["g"], ["v"], 3).orderBy("g", "v").collect()
    assert [(r["g"], r["v"]) for r in got] == [
        ("cold", 1), ("cold", 2), ("cold", 3), ("hot", 1001), ("hot", 1002), ("hot", 1003),
    ]


def test_hashed_rank_is_dense(spark):
    df = spark.range(3000).selectExpr("cast(id as string) as ID", "id % 2 as g")
    got = ordering.hashed_rank(df, ["g"], 42).groupBy("g").agg(
        F.min("rank"), F.max("rank"), F.countDistinct("rank")
    ).collect()
    assert all(tuple(r)[1:] == (1, 1500, 1500) for r in got)


def test_a_fold_without_rows_of_a_group_counts_as_zero(spark):
    """As in the SQL, where a group too small for its folds has an accuracy of 0 in the empty ones."""
    rows = [(str(k), "g", k % 2, float(k // 2), k // 2) for k in range(4)]
    df = spark.createDataFrame(rows, "ID string, g string, fold int, a double, y int")
    single = T.cv_threshold(df, "a", "y", 3, ("g",))
    pair = T.cv_pair(df.selectExpr("*", "-a as m"), "m", "a", "y", 3, ("g",))
    for got in (single, pair):
        assert {r.fold: r.test_acc for r in got.collect()} == {-1: None, 0: 1.0, 1: 1.0, 2: 0.0}
