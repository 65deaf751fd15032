"""Metrics, tests and votes against known values."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leakscope.functions import probability, saturation
from leakscope.functions.probability import binomial_quantiles, mcnemar_exact, normal_two_sided
from leakscope.operators import detectors as D
from leakscope.operators import metrics as M
from leakscope.operators import report as R
from leakscope.operators import shape
from leakscope.plans import tuning


def exact(b, c):
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def test_mcnemar(spark):
    cases = [(8, 4), (0, 0), (5, 5), (0, 9), (30, 31), (300, 260), (900, 800), (2000, 1800)]
    df = spark.createDataFrame(cases, "b long, c long")
    rows = df.select("b", "c", mcnemar_exact(F.col("b"), F.col("c")).alias("p")).collect()
    for r in rows:
        assert r["p"] == pytest.approx(exact(r["b"], r["c"]), rel=1e-8)
    assert rows[0]["p"] == pytest.approx(0.3876953125, abs=1e-12)


def test_normal_tail(spark):
    df = spark.createDataFrame([(z,) for z in (0.0, 0.5, 1.96, 4.0)], "z double")
    for r in df.select("z", normal_two_sided(F.col("z")).alias("p")).collect():
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)), abs=2e-7)


def test_metrics_are_zero_when_undefined(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "p int, LABEL_BINARY int")
    r = M.classification_metrics(df, "p").first()
    assert (r.accuracy, r.precision, r.recall, r.f1_score) == (1.0, 0.0, 0.0, 0.0)


def test_binomial_quantiles_against_sums():
    shares = np.array([1e-9, 0.025, 0.3, 0.5, 0.9, 0.975, 1 - 1e-12])
    for n, right in [(1, 0), (1, 1), (7, 3), (40, 39), (400, 260), (1000, 1), (1500, 750)]:
        p = Fraction(right, n)
        upto = np.cumsum([float(math.comb(n, k) * p**k * (1 - p) ** (n - k)) for k in range(n + 1)])
        want = [int(np.argmax(upto >= min(u, upto[-1]))) for u in shares]
        assert binomial_quantiles(n, right, shares).tolist() == want


def test_binomial_quantiles_of_many_rows(monkeypatch):
    """Far more rows than terms; several blocks of terms give the same."""
    n, right = 10**10, 3 * 10**9
    sd = math.sqrt(n * 0.3 * 0.7)
    got = binomial_quantiles(n, right, np.array([0.025, 0.5, 0.975]))
    assert (got - right) / sd == pytest.approx([-1.959964, 0, 1.959964], abs=1e-3)
    few = np.array([0.025, 0.5, 0.975])
    whole = binomial_quantiles(10**6, 4 * 10**5, few)
    monkeypatch.setattr(probability, "_TERMS", 997)
    assert binomial_quantiles(10**6, 4 * 10**5, few).tolist() == whole.tolist()


def test_bootstrap_is_the_percentile_of_all_draws(spark):
    counts = spark.createDataFrame(
        [("g", 400, 260), ("h", 30, 19), (None, 5, 5), ("none", 0, 0), ("big", 10**9, 10**8)],
        "g string, n long, right long",
    )
    got = {r["g"]: r for r in M.bootstrap_ci(counts, 1000, 7, ["g"]).collect()}
    for g, n, right in [("g", 400, 260), ("h", 30, 19), (None, 5, 5)]:
        digests = [hashlib.md5(f"7|{g or ''}|{b}".encode()).hexdigest() for b in range(1, 1001)]
        shares = np.array([(int(d[:12], 16) + 0.5) / 2**48 for d in digests])
        acc = binomial_quantiles(n, right, shares) / n
        want = np.percentile(acc, [2.5, 97.5])
        assert (got[g]["acc_lower"], got[g]["acc_upper"]) == pytest.approx(tuple(want))
    assert got["none"]["acc_lower"] is None and got["none"]["acc_upper"] is None
    assert got["big"]["acc_lower"] == pytest.approx(0.1, abs=1e-4)
    limit = {r["g"]: r for r in M.binomial_ci(counts, ["g"]).collect()}
    assert limit["g"]["acc_lower"] == pytest.approx(got["g"]["acc_lower"], abs=0.01)
    assert limit["g"]["acc_upper"] == pytest.approx(got["g"]["acc_upper"], abs=0.01)


def test_resampled_ci_makes_every_draw(spark, monkeypatch):
    counts = spark.createDataFrame(
        [("g", 25, 20), ("h", 40, 13), (None, 5, 5), ("none", 0, 0)], "g string, n long, right long"
    )
    monkeypatch.setattr(M, "DRAW_CHUNK", 7)
    got = {r["g"]: r for r in M.resampled_ci(counts, 200, 42, ["g"]).collect()}
    for g, n, right in [("g", 25, 20), ("h", 40, 13), (None, 5, 5)]:
        draws = [
            [int(hashlib.md5(f"42|{b}|{j}".encode()).hexdigest()[:12], 16) % n < right for j in range(1, n + 1)]
            for b in range(1, 201)
        ]
        want = np.percentile([np.mean(d) for d in draws], [2.5, 97.5])
        assert (got[g]["acc_lower"], got[g]["acc_upper"]) == pytest.approx(tuple(want))
    assert got["none"]["acc_lower"] is None and got["none"]["acc_upper"] is None


def test_bootstrap_query_and_its_sql_make_draws(spark):
    """Not binomial quantiles in place of the draws, in neither of the two."""
    from leakscope.plans import registry

    registry.load()
    assert "unnest(range(1, n + 1)) AS j" in registry.ORACLES["bootstrap_ci"]
    assert "lgamma" not in registry.ORACLES["bootstrap_ci"]


def test_mann_whitney_against_pairwise_counts(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(
        {"m": ["x"] * 80, "LABEL": np.where(rng.random(80) < 0.4, "Conta", "Clean"), "v": rng.integers(0, 6, 80)}
    )
    r = M.mann_whitney(spark.createDataFrame(pdf), ["m"], "LABEL", "v", "Conta", "Clean").first()
    a, b = pdf[pdf.LABEL == "Conta"].v.to_numpy(), pdf[pdf.LABEL == "Clean"].v.to_numpy()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n1, n2, n = len(a), len(b), 80
    ties = sum(t**3 - t for t in np.unique(pdf.v, return_counts=True)[1])
    s = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / s
    assert r["u1"] == pytest.approx(u)
    assert r["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)


def test_mann_whitney_one_side_empty(spark):
    df = spark.createDataFrame([("x", "Conta", 1), ("x", "Conta", 0)], "m string, LABEL string, v int")
    assert M.mann_whitney(df, ["m"], "LABEL", "v", "Conta", "Clean").first()["p_value"] is None


def test_constant_vote_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 0)], "a int, b int")
    got = {(r["method_a"], r["method_b"]): r["corr"] for r in M.vote_corr(df, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and got[("b", "b")] == 1.0


def test_votes_join_on_model_and_id(spark):
    """Same id in two models, items that a frame lacks, null votes and repeated rows."""
    kind = "model_id string, ID string, v int"
    a = spark.createDataFrame([("m", "1", 1), ("n", "1", 0), ("m", "2", None), ("m", "3", 1), (None, "1", 1)], kind)
    b = spark.createDataFrame([("m", "1", 0), ("n", "1", 0), ("m", "2", 1), ("m", "2", 1), (None, "1", 1)], kind)
    joined = D.join_votes([a, b.withColumnRenamed("v", "w")], ["v", "w"])
    assert {tuple(r) for r in joined.collect()} == {
        ("m", "1", 1, 0), ("n", "1", 0, 0), ("m", "2", None, 1), (None, "1", 1, 1),
    }
    got = {(r.model_id, r.ID): r.PREDICTION_BINARY for r in D.majority_vote(joined, ["v", "w"]).collect()}
    assert got["n", "1"] == 0 and got[None, "1"] == 1
    coin = {i: int(hashlib.md5(f"42|{i}".encode()).hexdigest()[0] < "8") for i in "12"}
    assert got["m", "1"] == coin["1"] and got["m", "2"] == coin["2"]
    assert "Join" not in joined._jdf.queryExecution().executedPlan().toString()


def test_majority_vote_and_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 0, 0), ("c", 1, 0)], "ID string, u int, v int")
    got = {r["ID"]: r["PREDICTION_BINARY"] for r in D.majority_vote(df, ["u", "v"]).collect()}
    assert got["a"] == 1 and got["b"] == 0 and got["c"] in (0, 1)


def test_predict_checks_the_threshold_shape(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1)], "a double, b double, LABEL_BINARY int")
    with pytest.raises(ValueError):
        M.predict(df, ("a", "b"), 0.5, "m")
    with pytest.raises(ValueError):
        tuning.evaluate(df, ("a", "b"), 0.5, "m", "d", "x", parameter1="exponential")
    with pytest.raises(ValueError):
        tuning.run_detector(df, lambda d: d, ("a", "b"), (0.1, None))


def test_rule_2d_with_nan(spark):
    df = spark.createDataFrame(
        [("a", float("nan"), 1.0, 1), ("b", 1.0, float("nan"), 0), ("c", 0.1, 0.0, 1)],
        "ID string, a double, b double, LABEL_BINARY int",
    )
    got = [r["m"] for r in M.predict(df, ("a", "b"), (0.5, 2.0), "m").orderBy("ID").collect()]
    assert got == [0, 0, 1]


def test_flags_keep_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, None)], "a double, b double")
    got = [r[0] for r in df.select(tuning.flag_curve(F.col("a"), F.col("b"), 0.5, 1.0)).collect()]
    assert got == [True, None]


def test_fits_recover_generated_curves(spark):
    rows = []
    for i, (a, b) in enumerate([(2.3, 0.015), (1.1, 0.2), (4.0, 0.004)]):
        rows.append((str(i), [-a * (1 - math.exp(-b * x)) for x in range(120)]))
    rows.append(("flat", [0.0] * 10))
    rows.append(("short", [0.0]))
    rows.append(("line", [-0.01 * x for x in range(50)]))
    df = spark.createDataFrame(rows, "ID string, curve array<double>")
    got = {r["ID"]: r for r in D.fit_exponential(df).collect()}
    for i, (a, b) in enumerate([(2.3, 0.015), (1.1, 0.2), (4.0, 0.004)]):
        assert got[str(i)]["A_value"] == pytest.approx(a, rel=1e-4)
        assert got[str(i)]["B_value"] == pytest.approx(b, rel=1e-4)
    for name in ("flat", "short"):
        assert got[name]["A_value"] is None and got[name]["B_value"] is None
    assert got["line"]["A_value"] is None and got["line"]["B_value"] == 0
    slope = {r["ID"]: r["m_value"] for r in D.curve_features(df, "linear").collect()}
    assert slope["line"] == pytest.approx(-0.01)
    with pytest.raises(ValueError):
        D.curve_features(df, "cubic")


def test_fit_of_signed_and_steep_rates(spark):
    """Negative, tiny, large and unbounded rates; rows that cannot be fitted stay with nulls."""
    want = {"rising": (-0.5, -0.05), "steep": (3.0, 5.0), "long": (1000.0, 1e-6), "fast": (1e-3, -0.4)}
    rows = [
        (name, [-a * -math.expm1(-b * x) for x in range(40)]) for name, (a, b) in want.items()
    ]
    rows += [("drop", [0.0] + [-1.0] * 20), ("end", [0.0] * 20 + [-3.0]), ("null", None), ("hole", [0.0, None, 1.0])]
    rows += [("nan", [0.0, math.nan, 1.0]), ("two", [0.0, -1.0]), ("none", [])]
    df = spark.createDataFrame(rows, "ID string, curve array<double>")
    got = {r["ID"]: (r["A_value"], r["B_value"]) for r in D.fit_exponential(df).collect()}
    assert set(got) == {r[0] for r in rows}
    for name, (a, b) in want.items():
        assert got[name] == (pytest.approx(a, rel=1e-6), pytest.approx(b, rel=1e-6))
    assert got["drop"] == (pytest.approx(1), pytest.approx(53 * math.log(2)))
    assert got["end"][1] == pytest.approx(-53 * math.log(2))
    assert got["two"] == (None, 0)
    for name in ("null", "hole", "nan", "none"):
        assert got[name] == (None, None)


@given(st.integers(0, 10**6), st.integers(3, 80))
@settings(max_examples=40, deadline=None)
def test_no_rate_of_a_wide_grid_fits_better(seed, length):
    rng = np.random.default_rng(seed)
    y = np.concatenate([[0], np.cumsum(-rng.exponential(size=length - 1))]) / length
    a, b = (v[0] for v in saturation.fit([y]))
    x = np.arange(length)
    model = -a * -np.expm1(-b * x) if b else x * (x @ y) / (x @ x)
    rates = np.exp(np.linspace(np.log(1e-10), np.log(8), 3000))[:, None]
    best = np.inf
    for g in (np.expm1(-rates * x), np.expm1(rates * x) / np.expm1(rates * x[-1])):
        scale = (g @ y) / (g * g).sum(axis=1)
        best = min(best, ((y - scale[:, None] * g) ** 2).sum(axis=1).min())
    assert ((y - model) ** 2).sum() <= best * (1 + 1e-9) + 1e-15


def test_missing_n_is_an_error(spark):
    df = spark.sql(
        "select 'a' ID, map(1, named_struct('TARGET_NGRAMS', array(array(1)), "
        "'PREDICTED_NGRAMS', array(array(1)), 'START_POINTS', array(0))) NGRAM_GENERATION_DATA"
    )
    assert D.ngram_features(df, [1]).first()["feature"] == 1.0
    with pytest.raises(Exception, match="n not found"):
        D.ngram_features(df, [1, 4]).collect()


def test_shape_helpers(spark):
    df = spark.createDataFrame(
        [("1", "x/m1", "5", None), ("2", "m2", "7", 0.2), (None, "x/m3", None, 0.15)],
        "ID string, model_id string, param_k string, param_alpha double",
    )
    assert [r["ID"] for r in shape.filter_params(df).collect()] == ["1"]
    assert shape.drop_null_id(df).count() == 2
    assert shape.conform(df, {"param_k": "int"}, quarantine=True).dtypes == [("param_k", "int")]
    assert shape.filter_models(df, keep=["m2"]).count() == 1
    assert [r["model_id"] for r in shape.pin_first(df, "model_id", "x/m3").collect()][0] == "x/m3"
    ids = df.where("ID = '1'")
    assert shape.in_ids(df, ids).count() == 1
    assert shape.not_in_ids(shape.drop_null_id(df), ids).count() == 1


def test_train_log_holds_grids_of_both_kinds(spark):
    """Entries of single thresholds and of pairs in one record, flattened again."""
    single = spark.createDataFrame(
        [("m", 1, 0.0, 0.1, [0.0, 0.2], 0.7, 0.6, [0.7, 0.7], [0.5, 0.7], True),
         ("m", 0, 2.5, 2.0, [2.0, None], 0.8, 0.6, [0.8, 0.8], [0.6, 0.6], False),
         ("n", 0, 1.0, 1.0, [1.0, 1.0], 0.9, 0.9, [0.9, 0.9], [0.9, 0.9], True)],
        "model_id string, grid_pos int, global_threshold double, median_threshold double, all_thresholds array<double>, "
        "mean_cvacc_train double, mean_cvacc_test double, all_cvacc_train array<double>, all_cvacc_test array<double>, is_best boolean",
    )
    pair = spark.createDataFrame(
        [("m", 2, 1.5, 0.5, 1.0, 0.4, [1.0, 2.0], [0.25, 0.75], 0.6, 0.4, [0.6, 0.6], [0.4, 0.4], True)],
        "model_id string, grid_pos int, global_threshold_1 double, global_threshold_2 double, median_threshold_1 double, "
        "median_threshold_2 double, all_thresholds_1 array<double>, all_thresholds_2 array<double>, mean_cvacc_train double, "
        "mean_cvacc_test double, all_cvacc_train array<double>, all_cvacc_test array<double>, is_best boolean",
    )
    k = F.create_map(F.lit("k"), (10 * F.col("grid_pos")).cast("string"))
    entries = tuning.log_entries(single, "minK", k).unionByName(
        tuning.log_entries(pair, "curve", F.create_map(F.lit("fit"), F.lit("exponential")), "exponential")
    )
    log = tuning.train_log(entries, "d", "minK", {"k": "[0, 10]"})
    assert log.count() == 2
    best = log.where("model_id = 'm'").select("best_log_entry.parameter", "CV_folds", "parameter_range").first()
    assert best["parameter"] == {"k": "0"} and best["CV_folds"] == 5 and best["parameter_range"] == {"k": "[0, 10]"}
    flat = {(r.model_id, r.grid_pos): r for r in R.flatten_train_logs(log).collect()}
    assert set(flat) == {("m", 0), ("m", 1), ("m", 2), ("n", 0)}
    assert flat["m", 1].global_threshold == [0.0] and flat["m", 2].global_threshold == [1.5, 0.5]
    assert flat["m", 2].method_name_with_param == "curve_fit=exponential" and flat["m", 2].param_k is None
    assert flat["m", 2].mean_threshold == pytest.approx(1.0)
    assert flat["m", 1].mean_val_acc == pytest.approx(0.6) and flat["m", 1].std_val_acc == pytest.approx(0.1)


def test_gaps_are_placed_by_contaminated_mean(spark):
    wide = spark.createDataFrame(
        [("a", 0.5, 0.1), ("b", None, 0.2), ("c", 0.9, None), ("d", 0.5, 0.3)], "m string, Conta_mean double, gap double"
    )
    got = [(r.m, r.place) for r in M.by_contaminated_mean(wide, "m").collect()]
    assert got == [("c", 0), ("a", 1), ("d", 2), ("b", 3)]
