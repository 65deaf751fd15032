"""Classification metrics, intervals and significance tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.probability import binomial_quantiles, mcnemar_exact, normal_two_sided
from leakscope.operators.ordering import exact_percentiles, join_null_safe, lay_out, running


def ratio(a: str, b: str) -> Column:
    """a / b as a double, 0 when undefined."""
    return F.expr(f"coalesce(try_divide(cast({a} as double), {b}), 0D)")


def classification_metrics(
    df: DataFrame, pred: str, label: str = "LABEL_BINARY", by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts and the rates from them, one aggregation pass."""
    p, y = f"`{pred}`", f"`{label}`"
    counts = df.groupBy(*by).agg(
        F.expr(f"count_if({y} = 1 and {p} = 1) as tp"),
        F.expr(f"count_if({y} = 0 and {p} = 1) as fp"),
        F.expr(f"count_if({y} = 1 and {p} = 0) as fn"),
        F.expr(f"count_if({y} = 0 and {p} = 0) as tn"),
    )
    return counts.select(
        *by,
        "tn",
        "fp",
        "fn",
        "tp",
        ratio("tn + tp", "tn + fp + fn + tp").alias("accuracy"),
        ratio("tp", "tp + fp").alias("precision"),
        ratio("tp", "tp + fn").alias("recall"),
        ratio("2 * tp", "2 * tp + fp + fn").alias("f1_score"),
    )


def baseline(df: DataFrame, name: str = "PREDICTION_BASE") -> DataFrame:
    """The constant-1 baseline."""
    return df.withColumn(name, F.lit(1))


def mcnemar(counts: DataFrame) -> DataFrame:
    """Adds b, c and the exact p value against the constant-1 baseline.

    The baseline is wrong on every negative and right on every positive, so b
    is the number of true negatives and c the number of false negatives.
    """
    return counts.withColumns({"mcnemar_b": F.col("tn"), "mcnemar_c": F.col("fn")}).withColumn(
        "mcnemar_p_value", mcnemar_exact(F.col("mcnemar_b"), F.col("mcnemar_c"))
    )


def _quantiles(n: pd.Series, right: pd.Series, shares: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(size) or not size else binomial_quantiles(int(size), int(hit), np.asarray(own)).tolist()
            for size, hit, own in zip(n, right, shares, strict=True)
        ]
    )


def _accuracy_at(shares: Column) -> Column:
    """Accuracies that resamples of n rows have at the given shares of their distribution."""
    hits = F.pandas_udf(_quantiles, "array<bigint>")(F.col("n"), F.col("right"), shares)
    return F.transform(hits, lambda k: k / F.col("n"))


def bootstrap_ci(
    counts: DataFrame, draws: int = 1000, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """Percentile bootstrap of accuracy from (n, right) per group.

    The hits among n rows drawn with replacement are exactly Binomial(n, right / n), so a
    resample is one quantile of it at a uniform share, the md5 of (seed, group, draw).
    Quantiles keep the order of shares, so only those next to the two percentiles are
    taken: no rows are made for draws, and the cost does not grow with draws times n.
    A group without rows has null bounds.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    share = lambda b: (
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *key, b.cast("string"))), 1, 12), 16, 10)
        .cast("bigint") + 0.5
    ) / float(1 << 48)
    ordered = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(draws)), share))
    places = [q * (draws - 1) for q in (0.025, 0.975)]
    picks = [min(int(x) + d, draws - 1) for x in places for d in (0, 1)]
    near = counts.select(*by, "n", "right", ordered.alias("_u")).withColumn(
        "_u", F.array(*[F.col("_u")[i] for i in picks])
    )
    found = near.withColumn("_acc", _accuracy_at(F.col("_u")))

    def between(first: int, place: float) -> Column:
        low, high = F.col("_acc")[first], F.col("_acc")[first + 1]
        return low + (high - low) * (place - int(place))

    return found.select(
        *by, between(0, places[0]).alias("acc_lower"), between(2, places[1]).alias("acc_upper")
    )


# Draws made by one row of the work list, so that no array grows with n.
DRAW_CHUNK = 10_000


def resampled_ci(
    counts: DataFrame, draws: int = 1000, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """Percentile bootstrap of accuracy from (n, right) per group, every draw of every resample made.

    A resample draws n rows with replacement; only whether a draw lands on one
    of the ``right`` rows matters, so rows are numbered with those first and
    never joined back. Work is draws x n, spread over tasks by draw number. A group
    without rows has null bounds.
    """
    spark = counts.sparkSession
    tasks = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    work = counts.select(
        *by, "n", "right", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b")
    ).withColumn("chunk", F.expr(f"explode(sequence(0L, greatest(n - 1, 0L) div {DRAW_CHUNK}L))"))
    # A fixed task number: the rows are few and tiny, but each stands for many draws.
    drawn = work.repartition(tasks, *by, "b", "chunk").withColumn(
        "j",
        F.expr(
            f"explode_outer(if(n > 0, sequence(chunk * {DRAW_CHUNK}L + 1L, "
            f"least((chunk + 1L) * {DRAW_CHUNK}L, n)), null))"
        ),
    )
    landed = F.expr(
        f"cast(conv(substr(md5(concat_ws('|', '{seed}', b, j)), 1, 12), 16, 10) as bigint) "
        "% nullif(n, 0L) < right"
    )
    hits = drawn.groupBy(*by, "b", "n").agg(F.count_if(landed).alias("hit"))
    return hits.withColumn("acc", F.try_divide(F.col("hit").cast("double"), F.col("n"))).groupBy(*by).agg(
        F.expr("percentile(acc, 0.025)").alias("acc_lower"),
        F.expr("percentile(acc, 0.975)").alias("acc_upper"),
    )


def binomial_ci(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What ``bootstrap_ci`` tends to with many draws."""
    both = _accuracy_at(F.array(F.lit(0.025), F.lit(0.975)))
    return counts.select(*by, "n", "right", both.alias("_acc")).select(
        *by, F.col("_acc")[0].alias("acc_lower"), F.col("_acc")[1].alias("acc_upper")
    )


def mean_ci(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and 1.96 standard errors per group."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.expr(
            f"1.96D * try_divide(stddev_samp(cast(`{value}` as double)), sqrt(count(`{value}`)))"
        ).alias("ci"),
        F.count(value).alias("n"),
    )


def mann_whitney(
    df: DataFrame, by: Sequence[str], group: str, value: str, first: str, second: str
) -> DataFrame:
    """Two-sided rank test with tie and continuity correction.

    Values are counted before they are ranked; the ranks come from running
    counts over ordered pieces.
    """
    counted = (
        df.where(F.col(group).isin(first, second))
        .groupBy(*by, value)
        .agg(
            F.count_if(F.col(group) == first).alias("n1"),
            F.count_if(F.col(group) == second).alias("n2"),
        )
    )
    ranked = running(lay_out(counted, by, [value]), {"below": "n1 + n2"})
    sums = ranked.groupBy(*by).agg(
        F.expr("cast(sum(n1) as double) as n1"),
        F.expr("cast(sum(n2) as double) as n2"),
        F.expr("sum(n1 * (below + (n1 + n2 + 1) / 2D)) as r1"),
        F.expr("sum(pow(n1 + n2, 3D) - (n1 + n2)) as ties"),
    )
    scored = sums.selectExpr(
        *[f"`{c}`" for c in by],
        "n1",
        "n2",
        "r1 - n1 * (n1 + 1) / 2 as u1",
        "n1 * n2 / 12 * ((n1 + n2 + 1) - coalesce(try_divide(ties, (n1 + n2) * (n1 + n2 - 1)), 0D)) as s2",
    )
    z = F.expr(
        "try_divide(greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5D, sqrt(s2))"
    )
    p = F.when(z < 0, F.lit(1.0)).otherwise(normal_two_sided(z))
    return scored.select(
        *by,
        F.col("n1").cast("bigint").alias("n1"),
        F.col("n2").cast("bigint").alias("n2"),
        F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("u1")).alias("u1"),
        F.when(
            (F.col("n1") > 0) & (F.col("n2") > 0),
            F.when(F.col("s2") > 0, p).otherwise(F.lit(1.0)),
        ).alias("p_value"),
    )


def performance_gap(
    df: DataFrame, model: str = "MODEL_SHORT", label: str = "LABEL", value: str = "CORRECTNESS"
) -> DataFrame:
    """Accuracy on contaminated and clean items, the gap and its rank-test p."""
    means = df.groupBy(model).agg(
        F.avg(F.when(F.col(label) == "Conta", F.col(value))).alias("acc_conta"),
        F.avg(F.when(F.col(label) == "Clean", F.col(value))).alias("acc_clean"),
    )
    tests = mann_whitney(df, [model], label, value, "Conta", "Clean").select(model, "p_value")
    return join_null_safe(means, tests, [model], "left").withColumn(
        "gap", F.col("acc_conta") - F.col("acc_clean")
    )


def gap_pivot(
    df: DataFrame, index: str, label: str = "LABEL", value: str = "CORRECTNESS",
    absolute: bool = False,
) -> DataFrame:
    """Means and interval widths by label side by side, with their gap."""
    wide = (
        df.groupBy(index)
        .pivot(label, ["Conta", "Clean"])
        .agg(
            F.avg(value).alias("mean"),
            F.expr(
                f"1.96D * try_divide(stddev_samp(cast(`{value}` as double)), sqrt(count(`{value}`)))"
            ).alias("ci"),
        )
    )
    gap = F.col("Conta_mean") - F.col("Clean_mean")
    return wide.withColumn("gap", F.abs(gap) if absolute else gap)


def by_contaminated_mean(pivot: DataFrame, index: str) -> DataFrame:
    """A gap pivot with its rows' ``place``: highest Conta mean first, missing means last.

    Ties follow ``index``. Places come from sorted ranges, not from one task.
    """
    keyed = pivot.withColumns(
        {
            "_all": F.lit(0),
            "_none": F.col("Conta_mean").isNull().cast("int"),
            "_down": -F.coalesce("Conta_mean", F.lit(0.0)),
        }
    )
    ranked = running(lay_out(keyed, ["_all"], ["_none", "_down", index]), {"place": "1L"})
    return ranked.select(*pivot.columns, "place").orderBy("place")


def vote_corr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, 2 decimals; null for constants."""
    pairs = [(a, b) for a in cols for b in cols]
    aggs = [
        F.expr(
            f"try_divide(covar_pop(cast(`{a}` as double), cast(`{b}` as double)), "
            f"stddev_pop(`{a}`) * stddev_pop(`{b}`)) as c{i}"
        )
        for i, (a, b) in enumerate(pairs)
    ]
    rows = ", ".join(
        f"named_struct('method_a', '{a}', 'method_b', '{b}', 'corr', round(c{i}, 2))"
        for i, (a, b) in enumerate(pairs)
    )
    return df.agg(*aggs).selectExpr(f"inline(array({rows}))")


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles and the whiskers inside 1.5 interquartile ranges."""
    quartiles = exact_percentiles(df, by, value, {"q1": 0.25, "med": 0.5, "q3": 0.75})
    inside = F.col(value).between(
        F.expr("q1 - 1.5D * (q3 - q1)"), F.expr("q3 + 1.5D * (q3 - q1)")
    )
    return (
        join_null_safe(df.select(*by, value), quartiles, by)
        .groupBy(*by)
        .agg(
            F.first("q1").alias("q1"),
            F.first("med").alias("med"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        )
    )


def line_accuracy(df: DataFrame, output: str = "output", label: str = "label") -> DataFrame:
    """Rows, hits and accuracy of a method's line log; 0 when empty."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(output) == F.col(label)).alias("correct"),
    ).withColumn("accuracy", ratio("correct", "total"))


def accuracy_by_param(df: DataFrame, by: Sequence[str], correct: str = "CORRECT_PRED") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(correct).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def length_report(df: DataFrame, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean array length before and after truncation."""
    return df.groupBy(*by).agg(
        F.avg(F.size(before)).alias("mean_before"), F.avg(F.size(after)).alias("mean_after")
    )


def predict(
    df: DataFrame,
    feature: str | Sequence[str],
    theta: float | Sequence[float],
    method: str,
    label: str = "LABEL_BINARY",
    strict: bool = True,
) -> DataFrame:
    """Adds PREDICTION_BINARY, CORRECT_PRED, THRESHOLD and the method's vote column."""
    if isinstance(theta, (tuple, list)) != isinstance(feature, (tuple, list)):
        raise ValueError("a pair of thresholds needs a pair of features")
    if isinstance(theta, (tuple, list)):
        if len(theta) != 2 or len(feature) != 2:
            raise ValueError("a threshold pair has exactly two parts")
        from leakscope.operators.thresholds import rule_2d

        rule = rule_2d(
            F.col(feature[0]), F.col(feature[1]), F.lit(float(theta[0])), F.lit(float(theta[1]))
        )
        shown = f"({theta[0]}, {theta[1]})"
    else:
        value = F.when(~F.isnan(feature), F.col(feature))
        limit = F.lit(float(theta))
        rule = F.coalesce(value > limit if strict else value >= limit, F.lit(False))
        shown = str(theta)
    return df.withColumns(
        {
            "PREDICTION_BINARY": rule.cast("int"),
            "CORRECT_PRED": (rule.cast("int") == F.col(label)).cast("int"),
            "THRESHOLD": F.lit(shown),
            method: rule.cast("int"),
        }
    )
