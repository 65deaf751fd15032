"""Row-local functions against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.functions import arrays as A


def one(spark, sql, expr):
    return spark.sql(f"select {sql}").select(expr.alias("v")).first()[0]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_token_distance_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    pairs = [([], []), ([1], []), ([], [1, 2]), ([5, 5, 5], [5, 5])]
    for _ in range(60):
        pairs.append(
            tuple(rng.integers(0, 6, rng.integers(0, 12)).tolist() for _ in range(2))
        )
    df = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<int>, b array<int>"
    )
    rows = df.select(
        "i",
        A.token_distance(F.col("a"), F.col("b")).alias("d"),
        A.token_distance(F.col("b"), F.col("a")).alias("r"),
    ).collect()
    for r in rows:
        a, b = pairs[r["i"]]
        assert r["d"] == r["r"] == edit(a, b)
        assert (r["d"] == 0) == (a == b)
        assert r["d"] <= max(len(a), len(b))


@pytest.mark.parametrize("limit", [-3, 0, 1, 3, 20])
def test_token_distance_stops_at_its_limit(spark, limit):
    rng = np.random.default_rng(limit + 3)
    pairs = [([], []), ([1], []), ([], [1, 2]), (None, [1]), ([1, 2], None)]
    for _ in range(60):
        pairs.append(tuple(rng.integers(0, 4, rng.integers(0, 14)).tolist() for _ in range(2)))
    df = spark.createDataFrame(pairs, "a array<int>, b array<int>")
    got = df.select("a", "b", A.token_distance(F.col("a"), F.col("b"), F.lit(limit)).alias("d"))
    for r in got.collect():
        null = r["a"] is None or r["b"] is None
        assert r["d"] == (None if null else min(edit(r["a"], r["b"]), max(limit, 0) + 1))


def test_token_distance_many_distinct_tokens(spark):
    # Past the surrogate block: 60,000 distinct tokens in one pair.
    point = A._one_char(F.col("p"))
    got = spark.range(1, 70001).select(F.col("id").alias("p")).select(point.alias("c"))
    assert got.distinct().count() == 70000
    assert got.where(F.length("c") != 1).count() == 0


def test_token_distance_words(spark):
    a, b = F.array(F.lit("für"), F.lit("e")), F.array(F.lit("fur"), F.lit("e"), F.lit("x"))
    assert spark.range(1).select(A.token_distance(a, b)).first()[0] == 2


@pytest.mark.parametrize("k,want", [(20, 0.1), (40, 0.15), (100, 0.3), (10, None)])
def test_mink(spark, k, want):
    got = one(spark, "array(0.5D, 0.1D, 0.4D, 0.2D, 0.3D) a", A.mink(F.col("a"), F.lit(float(k))))
    assert got is None if want is None else got == pytest.approx(want)


def test_mink_never_falls_with_k(spark):
    values = np.random.default_rng(0).random(57).tolist()
    df = spark.createDataFrame([(values,)], "a array<double>")
    got = df.select(*[A.mink(F.col("a"), F.lit(float(k))).alias(f"k{k}") for k in range(2, 101, 7)]).first()
    assert list(got) == sorted(got)


def starts(length, n, count, offset):
    if length <= offset + n:
        offset = max(1, min(offset, length // 3))
    room = length - offset - n
    if room <= 0:
        return None
    points = list(range(offset, length - n))
    count = min(count, len(points))
    if count == 1:
        return [offset + room // 2]
    return [points[i] for i in np.linspace(0, len(points) - 1, num=count, dtype=int)]


def test_start_points_even(spark):
    cases = [(L, n, k, o) for L in range(1, 60, 3) for n in (1, 3, 7) for k in (1, 2, 5, 20) for o in (0, 5)]
    for k in (1, 2, 5, 20):
        for o in (0, 5):
            mine = [c for c in cases if c[2] == k and c[3] == o]
            df = spark.createDataFrame([(c[0], c[1]) for c in mine], "L int, n int")
            rows = df.select("L", "n", A.start_points_even(F.col("L"), F.col("n"), k, o).alias("p")).collect()
            for r in rows:
                assert r["p"] == starts(r["L"], r["n"], k, o), (r, k, o)


def test_start_points_random(spark):
    df = spark.createDataFrame([("a", 40), ("b", 12), ("c", 3)], "ID string, L int")
    rows = df.select(
        "ID", "L", A.start_points_random(F.col("L"), 3, 5, 5, 42, F.col("ID")).alias("p")
    ).collect()
    for r in rows:
        low = 5 if r["L"] > 8 else max(1, min(5, r["L"] // 3))
        room = list(range(low, r["L"] - 3))
        if not room:
            assert r["p"] is None
            continue
        assert len(set(r["p"])) == len(r["p"]) == min(5, len(room))
        assert set(r["p"]) <= set(room)


def test_ngram_accuracy_cuts_to_the_shorter(spark):
    df = spark.createDataFrame(
        [(1, [[1, 2], [3, 4], [5, 6]], [[1, 2], [3, 9]]), (2, [], [[1]]), (3, [[7]], [[7]])],
        "i int, t array<array<int>>, p array<array<int>>",
    )
    got = {r["i"]: r["v"] for r in df.select("i", A.ngram_accuracy(F.col("t"), F.col("p")).alias("v")).collect()}
    assert got == {1: 0.5, 2: 0.0, 3: 1.0}


def test_ngram_loglike_is_short_at_the_end(spark):
    got = one(
        spark, "array(-1D, -2D, -3D) a, array(0, 2) s",
        A.ngram_loglike(F.col("a"), F.col("s"), 2),
    )
    assert got == [-3.0, -3.0]


def test_truncate_keeps_the_end_token(spark):
    got = one(
        spark, "array(array(1, 9, 2), array(3), array(9)) a",
        A.truncate_samples(F.col("a"), F.lit(9)),
    )
    assert got == [[1, 9], [3], [9]]


def test_peak_and_rho(spark):
    df = spark.sql("select array(0, 2, 2, 10) d, 10 m")
    row = df.select(
        *[A.peak(F.col("d"), F.col("m"), F.lit(a)).alias(f"a{i}") for i, a in enumerate((0.0, 0.2, 0.5, 1.0))],
        A.rho_star(F.col("d")).alias("rho"),
    ).first()
    assert list(row)[:4] == [0.25, 0.75, 0.75, 1.0]
    assert row["rho"] == {0: 0.25, 2: 0.5, 10: 0.25}
    assert sum(row["rho"].values()) == 1.0
