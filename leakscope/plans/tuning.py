"""Tuning over a parameter grid, held-out evaluation and end-to-end runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.operators import metrics, thresholds
from leakscope.operators.ordering import join_null_safe
from leakscope.operators.thresholds import GLOBAL_FOLD
from leakscope.session import settle


def _summary(cv: DataFrame, by: Sequence[str], pair: bool) -> DataFrame:
    """Log entry per grid value from its fold rows; 6 decimals, half to even."""
    fold = F.col("fold") != GLOBAL_FOLD

    def listed(col: str) -> Column:
        inside = F.array_sort(
            F.collect_list(F.when(fold, F.struct(F.col("fold"), F.bround(col, 6).alias("v"))))
        )
        return F.transform(inside, lambda s: s["v"])

    def whole(col: str) -> Column:
        return F.bround(F.max(F.when(~fold, F.col(col))), 6)

    def median(col: str) -> Column:
        return F.bround(F.median(F.when(fold, F.col(col))), 6)

    if pair:
        special = [
            whole("ta").alias("global_threshold_1"), whole("tb").alias("global_threshold_2"),
            median("ta").alias("median_threshold_1"), median("tb").alias("median_threshold_2"),
            listed("ta").alias("all_thresholds_1"), listed("tb").alias("all_thresholds_2"),
        ]
    else:
        special = [
            whole("t").alias("global_threshold"), median("t").alias("median_threshold"),
            listed("t").alias("all_thresholds"),
        ]
    return cv.groupBy(*by).agg(
        *special,
        F.bround(F.avg(F.when(fold, F.col("train_acc"))), 6).alias("mean_cvacc_train"),
        F.bround(F.avg(F.when(fold, F.col("test_acc"))), 6).alias("mean_cvacc_test"),
        listed("train_acc").alias("all_cvacc_train"),
        listed("test_acc").alias("all_cvacc_test"),
    )


def _mark_best(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """``is_best``: highest mean test accuracy, the earliest grid value on ties."""
    groups = [c for c in by if c != "grid_pos"]
    keyed = entries.withColumn("_g", F.lit(0))
    best = keyed.groupBy("_g", *groups).agg(
        F.min(F.struct((-F.col("mean_cvacc_test")).alias("s"), "grid_pos"))["grid_pos"].alias(
            "_best"
        )
    )
    return (
        join_null_safe(keyed, best, ["_g", *groups])
        .withColumn("is_best", F.col("grid_pos") == F.col("_best"))
        .drop("_g", "_best")
    )


def tune(
    features: DataFrame,
    k: int = 5,
    seed: int = 42,
    by: Sequence[str] = ("grid_pos",),
    feature: str = "feature",
    label: str = "LABEL_BINARY",
    folds_by: Sequence[str] = (),
) -> DataFrame:
    """Cross-validated threshold per grid value, all grid values in one job.

    ``features`` is long: one row per item and grid value. Folds depend on the
    item alone, so every grid value sees the same folds.
    """
    features = settle(features)
    items = features.select(*folds_by, "ID", label).distinct()
    folds = thresholds.stratified_folds(items, k, seed, label, folds_by)
    keyed = join_null_safe(features.drop("fold"), folds.drop(label), [*folds_by, "ID"])
    cv = thresholds.cv_threshold(keyed, feature, label, k, by)
    return _mark_best(_summary(cv, by, pair=False), by)


def tune_pair(
    features: DataFrame,
    a: str = "A_value",
    b: str = "B_value",
    k: int = 5,
    seed: int = 42,
    by: Sequence[str] = ("grid_pos",),
    label: str = "LABEL_BINARY",
) -> DataFrame:
    """The same for two features under ``a < ta or b > tb``."""
    features = settle(features)
    items = features.select("ID", label).distinct()
    folds = thresholds.stratified_folds(items, k, seed, label)
    keyed = features.drop("fold").join(folds.drop(label), "ID")
    cv = thresholds.cv_pair(keyed, a, b, label, k, by)
    return _mark_best(_summary(cv, by, pair=True), by)


def log_entries(
    tuned: DataFrame, method: str, parameter: Column, fit: str | None = None
) -> DataFrame:
    """Tuning results as log entries: the columns of ``tuned`` that name groups, and ``entry``.

    One type holds every kind of grid: parameters are a map of text, and thresholds,
    a number or a pair, are variants. Entries of several grids can be put in one union.
    """
    pair = "global_threshold_1" in tuned.columns

    def variant(value: Column) -> Column:
        return F.try_parse_json(F.to_json(F.struct(value.alias("v"))))

    if pair:
        both = variant(F.array("global_threshold_1", "global_threshold_2"))
        listed = variant(
            F.transform(
                F.arrays_zip("all_thresholds_1", "all_thresholds_2"),
                lambda t: F.array(t["all_thresholds_1"], t["all_thresholds_2"]),
            )
        )
    else:
        both, listed = variant(F.col("global_threshold")), variant(F.col("all_thresholds"))
    middle = ("median_threshold", "median_threshold_1", "median_threshold_2")
    entry = F.struct(
        F.lit(method).alias("method"),
        F.lit(fit).cast("string").alias("fit"),
        parameter.cast("map<string,string>").alias("parameter"),
        F.try_variant_get(both, "$.v", "variant").alias("global_threshold"),
        *[
            (F.col(c) if c in tuned.columns else F.lit(None)).cast("double").alias(c)
            for c in middle
        ],
        "mean_cvacc_train",
        "mean_cvacc_test",
        F.try_variant_get(listed, "$.v", "variant").alias("all_thresholds"),
        "all_cvacc_train",
        "all_cvacc_test",
    )
    special = {"is_best", "mean_cvacc_train", "mean_cvacc_test", "all_cvacc_train", "all_cvacc_test"}
    keys = [c for c in tuned.columns if c not in special and "threshold" not in c]
    return tuned.select(*keys, entry.alias("entry"))


def train_log(
    entries: DataFrame,
    data_set: str,
    method_name: str,
    parameter_range: dict[str, str],
    k: int = 5,
    seed: int = 42,
) -> DataFrame:
    """One tuning record per model_id in the train log's shape, from (model_id, grid_pos, entry).

    Entries stand in grid order; the best has the highest mean test accuracy, the earliest
    of several. A record holds the grid, whose size does not depend on the items.
    """
    in_order = F.array_sort(
        F.collect_list(F.struct("grid_pos", "entry")),
        lambda a, b: (a["grid_pos"] - b["grid_pos"]).cast("int"),
    )
    pairs = [F.lit(v) for kv in parameter_range.items() for v in kv]
    grid = F.create_map(*pairs) if pairs else F.map_from_arrays(F.array(), F.array())
    top = F.array_max(F.transform("all_log_entries", lambda e: e["mean_cvacc_test"]))
    best = F.filter("all_log_entries", lambda e: e["mean_cvacc_test"] == top)
    return (
        entries.groupBy("model_id")
        .agg(in_order.alias("e"))
        .select(
            "model_id",
            F.lit(data_set).alias("data_set"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("datetime"),
            F.lit(method_name).alias("method_name"),
            grid.cast("map<string,string>").alias("parameter_range"),
            F.lit(k).alias("CV_folds"),
            F.lit(seed).alias("CV_seed"),
            F.col("e.entry").alias("all_log_entries"),
        )
        .withColumn("best_log_entry", F.get(best, F.lit(0)))
    )


def evaluate(
    df: DataFrame,
    feature: str | Sequence[str],
    theta: float | Sequence[float] | str,
    model_id: str,
    data_name: str,
    method: str,
    parameter1: str | None = None,
    parameter2: str | None = None,
    draws: int = 1000,
    seed: int = 42,
    label: str = "LABEL_BINARY",
) -> DataFrame:
    """Run record of a fixed rule on held-out items, in the test log's shape.

    Three rules: an existing vote column for ensembles, a pair for the
    exponential fit, ``x > theta`` otherwise.
    """
    if "ensemble" in method.lower():
        scored = df.withColumn("_pred", F.col(feature).cast("int"))
    else:
        pair = parameter1 == "exponential"
        if pair and not (
            isinstance(theta, (tuple, list)) and isinstance(feature, (tuple, list))
            and len(theta) == 2 and len(feature) == 2
        ):
            raise ValueError("the exponential fit needs two features and two thresholds")
        scored = metrics.predict(df, feature, theta, "_pred", label)
    counts = metrics.mcnemar(metrics.classification_metrics(scored, "_pred", label))
    counts = counts.withColumns(
        {"n": F.expr("tn + fp + fn + tp"), "right": F.expr("tn + tp"), "_one": F.lit(1)}
    )
    ci = metrics.bootstrap_ci(counts, draws, seed).withColumn("_one", F.lit(1))
    shown = str(tuple(theta)) if isinstance(theta, list) else str(theta)
    return counts.join(ci, "_one").select(
        F.lit(model_id).alias("model_id"),
        F.lit(data_name).alias("data_name"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("datetime"),
        F.lit(method).alias("method_name"),
        F.struct(
            F.lit(parameter1).cast("string").alias("parameter1"),
            F.lit(parameter2).cast("string").alias("parameter2"),
            F.lit(shown).alias("theta"),
        ).alias("parameter"),
        F.struct(
            "accuracy",
            F.array("acc_lower", "acc_upper").alias("accuracy_95CI"),
            "precision",
            "recall",
            "f1_score",
            F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
            "mcnemar_b",
            "mcnemar_c",
            "mcnemar_p_value",
        ).alias("metrics"),
        F.lit(draws).alias("n_bootstrap"),
        F.lit(seed).alias("seed"),
    )


def run_on(
    df: DataFrame, feature: str | Sequence[str], theta: float | Sequence[float],
    strict: bool = True, label: str = "LABEL_BINARY",
) -> DataFrame:
    """Metrics of a fixed threshold on a feature table."""
    scored = metrics.predict(df, feature, theta, "_pred", label, strict)
    return metrics.classification_metrics(scored, "_pred", label)


def run_detector(
    source: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    feature: str | Sequence[str],
    theta: float | Sequence[float] | None,
    strict: bool = True,
) -> DataFrame:
    """Source to metrics in one lazy plan."""
    if theta is None or (isinstance(theta, (tuple, list)) and any(t is None for t in theta)):
        raise ValueError("a threshold must be given for every feature")
    return run_on(build(source), feature, theta, strict)


def flag(value: Column, delta: Column | float) -> Column:
    """Single-row decision ``value > delta``; null stays null."""
    return value > (F.lit(delta) if isinstance(delta, float) else delta)


def flag_curve(a: Column, b: Column, ta: float, tb: float) -> Column:
    """Curve decision with three outcomes: true, false, or null when the fit failed."""
    return F.when(a.isNotNull() & b.isNotNull(), (a < F.lit(ta)) | (b > F.lit(tb)))
