"""Run logs to summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions import arrays as A
from leakscope.functions.text import method_label, model_name, plus_minus
from leakscope.operators.shape import best_per_group, filter_params

def flatten_test_logs(logs: DataFrame, params: Sequence[str] = ("parameter1", "parameter2", "theta")) -> DataFrame:
    """One row per test log: metrics as columns, parameters as ``param_*``."""
    m = F.col("metrics")
    ci = F.coalesce(m["accuracy_95CI"], F.array().cast("array<double>"))
    passed = [c for c in ("file_name", "file_path") if c in logs.columns]
    return logs.select(
        *passed,
        F.coalesce("model_id", F.lit("unknown_model")).alias("model_id"),
        "data_name",
        "datetime",
        F.coalesce("method_name", F.lit("unknown_method")).alias("method_name"),
        method_label(
            F.coalesce("method_name", F.lit("unknown_method")), F.col("parameter")
        ).alias("method_name_with_param"),
        *[m[c].alias(c) for c in ("accuracy", "precision", "recall", "f1_score")],
        F.try_element_at(ci, F.lit(1)).alias("accuracy_95CI_lower"),
        F.try_element_at(ci, F.lit(2)).alias("accuracy_95CI_upper"),
        *[
            m[c].alias(c)
            for c in ("confusion_matrix", "mcnemar_b", "mcnemar_c", "mcnemar_p_value")
        ],
        "n_bootstrap",
        "seed",
        *[F.col("parameter")[p].alias(f"param_{p}") for p in params],
    )


def _numbers(value: Column) -> Column:
    """A variant list of numbers or of pairs as one flat array."""
    flat = F.try_variant_get(value, "$", "array<double>")
    pairs = F.flatten(F.try_variant_get(value, "$", "array<array<double>>"))
    return F.when(F.forall(flat, lambda x: x.isNotNull()), flat).otherwise(pairs)


def flatten_train_logs(
    logs: DataFrame, params: Sequence[str] = ("k", "alpha", "n", "fit"), zero_is_null: bool = False
) -> DataFrame:
    """One row per tuning entry with means and population deviations of its arrays.

    ``global_threshold`` holds one value or a pair. ``zero_is_null`` turns a
    threshold of exactly 0 into null, for tables that must match older reports.
    """
    passed = [c for c in ("file_name", "file_path") if c in logs.columns]
    entries = logs.select(
        *passed,
        F.coalesce("model_id", F.lit("unknown_model")).alias("model_id"),
        F.col("data_set").alias("data_name"),
        F.posexplode("all_log_entries").alias("grid_pos", "e"),
    )
    e = F.col("e")
    method = F.coalesce(e["method"], F.lit("unknown"))
    single = F.try_variant_get(e["global_threshold"], "$", "double")
    pair = F.try_variant_get(e["global_threshold"], "$", "array<double>")
    theta = F.coalesce(F.when(single.isNotNull(), F.array(single)), pair)
    if zero_is_null:
        theta = F.when(~((F.size(theta) == 1) & (theta[0] == 0)), theta)
    numbers = {
        "val_acc": e["all_cvacc_test"],
        "train_acc": e["all_cvacc_train"],
        "threshold": _numbers(e["all_thresholds"]),
    }
    return entries.select(
        "data_name",
        *passed,
        "model_id",
        "grid_pos",
        method.alias("method_name"),
        method_label(method, e["parameter"]).alias("method_name_with_param"),
        *[
            stat(values).alias(f"{kind}_{name}")
            for name, values in numbers.items()
            for kind, stat in (("mean", A.array_mean), ("std", A.array_stddev_pop))
        ],
        theta.alias("global_threshold"),
        *[e["parameter"][p].alias(f"param_{p}") for p in params],
    )


def best_entries(train: DataFrame) -> DataFrame:
    """Entry with the highest validation accuracy per model and method."""
    return best_per_group(train, ["model_id", "method_name"], "mean_val_acc", "grid_pos")


def accuracy_matrix(
    df: DataFrame,
    model: str,
    method: str,
    accuracy: str,
    upper: str | None,
    methods: Sequence[str],
    drop: Sequence[str] = ("Ensemble",),
) -> DataFrame:
    """Accuracy per model and method, with the interval half width when given."""
    kept = [m for m in methods if m not in drop]
    aggs = [F.first(accuracy).alias("accuracy")]
    if upper is not None:
        aggs.append(F.first(F.col(upper) - F.col(accuracy)).alias("ci"))
    return df.where(F.col(method).isin(kept)).groupBy(model).pivot(method, kept).agg(*aggs)


# Metric -> (column suffix, digits of the mean, digits of the deviation).
ROUNDING = {"accuracy": ("val_acc", 2, 3), "train_accuracy": ("train_acc", 2, 3), "threshold": ("threshold", 4, 4)}
BASELINE = "baseline"


def _metric_pivot(df: DataFrame, metric: str, models: Sequence[str], as_text: bool) -> DataFrame:
    suffix, mean_digits, std_digits = ROUNDING[metric]
    rounded = df.withColumns(
        {
            "m": F.bround(f"mean_{suffix}", mean_digits),
            "s": F.bround(f"std_{suffix}", std_digits),
        }
    )
    grouped = rounded.groupBy("method_name_with_param").pivot("model_name", list(models))
    overall = rounded.groupBy("method_name_with_param").agg(
        F.bround(F.avg("m"), 4).alias("result_mean"), F.bround(F.stddev_samp("m"), 4).alias("result_std")
    )
    key = "method_name_with_param"
    if as_text:
        cells = grouped.agg(F.first(plus_minus(F.col("m"), F.col("s"))))
        result = overall.select(
            key, plus_minus(F.col("result_mean"), F.col("result_std")).alias("result"),
            F.col("result_mean").alias("_key"),
        )
    else:
        cells = grouped.agg(F.avg("m").alias("mean"), F.avg("s").alias("std"))
        result = overall.withColumn("_key", F.col("result_mean"))
    return cells.join(result, key)


def add_baseline(pivot: DataFrame, metric: str, as_text: bool) -> DataFrame:
    """Append the constant baseline: 0.5 for accuracy, empty otherwise."""
    spark = pivot.sparkSession
    if as_text:
        value = F.lit("0.5 ± 0.0" if metric == "accuracy" else "")
    else:
        value = F.lit(0.5 if metric == "accuracy" else None).cast("double")
    row = spark.range(1).select(
        *[
            F.lit(BASELINE).alias(c)
            if c == "method_name_with_param"
            else (F.lit(None).cast("double") if c == "_key" else value).alias(c)
            for c in pivot.columns
        ]
    )
    return pivot.unionByName(row)


def summary_table(
    train: DataFrame,
    metric: str = "accuracy",
    sort_by: str = "accuracy",
    as_text: bool = True,
    models: Sequence[str] | None = None,
    ascending: bool = False,
) -> DataFrame:
    """Methods by models, with the result over models, a baseline row last, sorted.

    ``models`` fixes the pivot columns; without it the distinct model names,
    one small aggregate, are read first.
    """
    if metric not in ROUNDING:
        raise ValueError(f"metric must be one of {sorted(ROUNDING)}")
    if sort_by not in ("accuracy", "train_accuracy"):
        raise ValueError("sort_by must be 'accuracy' or 'train_accuracy'")
    df = filter_params(train.withColumn("model_name", model_name(F.col("model_id"))))
    if models is None:
        models = [r[0] for r in df.select("model_name").distinct().orderBy("model_name").collect()]
    table = add_baseline(_metric_pivot(df, metric, models, as_text), metric, as_text)
    if metric != sort_by:
        order = _metric_pivot(df, sort_by, models, as_text).select(
            "method_name_with_param", F.col("_key").alias("_order")
        )
        table = table.join(order, "method_name_with_param", "left")
    else:
        table = table.withColumn("_order", F.col("_key"))
    place = F.asc_nulls_last("_order") if ascending else F.desc_nulls_last("_order")
    last = F.col("method_name_with_param") == BASELINE
    return table.orderBy(last, place, "method_name_with_param").drop("_order", "_key")
