"""Detector features per item and parameter value, in long format."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.functions import arrays as A
from leakscope.functions import saturation


def with_grid(df: DataFrame, grid: Sequence[Mapping[str, object]]) -> DataFrame:
    """Each row once per grid entry, with ``grid_pos`` and one column per parameter.

    The grid is a literal array, so this is a row-local explode.
    """
    entries = [
        F.struct(
            F.lit(i).alias("grid_pos"), *[F.lit(v).alias(k) for k, v in entry.items()]
        )
        for i, entry in enumerate(grid)
    ]
    return df.select("*", F.inline(F.array(*entries)))


def mink_features(tokens: DataFrame, ks: Sequence[float]) -> DataFrame:
    """Scores are sorted once per item and sliced for every k."""
    ordered = tokens.withColumn("_p", F.array_sort("token_probs"))
    grid = with_grid(ordered, [{"k": float(k)} for k in ks])
    return grid.withColumn("feature", A.mink_sorted(F.col("_p"), F.col("k"))).drop("_p")


def ngram_features(generation: DataFrame, ns: Sequence[int]) -> DataFrame:
    """Accuracy per n from NGRAM_GENERATION_DATA; a missing n is an error."""
    have = F.array_sort(F.map_keys("NGRAM_GENERATION_DATA"))
    grid = with_grid(generation, [{"n": n} for n in ns])
    entry = F.element_at("NGRAM_GENERATION_DATA", F.col("n"))
    checked = F.when(
        F.array_contains(have, F.col("n")),
        A.ngram_accuracy(entry["TARGET_NGRAMS"], entry["PREDICTED_NGRAMS"]),
    ).otherwise(
        F.raise_error(
            F.concat(
                F.lit("n not found: "), F.col("n").cast("string"), F.lit(", available: "),
                F.to_json(have),
            )
        )
    )
    return grid.withColumn("feature", checked).drop("NGRAM_GENERATION_DATA")


def ngram_ll_features(
    tokens: DataFrame, ns: Sequence[int], starts: int = 20, offset: int = 5,
    only_problem: bool = False,
) -> DataFrame:
    """Mean over start points of the summed log-likelihood of n tokens."""
    scores = F.col("token_log_likes")
    if only_problem:
        scores = A.problem_only(scores, F.col("problem_length"))
    grid = with_grid(tokens.withColumn("_ll", scores), [{"n": n} for n in ns])
    points = A.start_points_even(F.size("_ll"), F.col("n"), starts, offset)
    return (
        grid.withColumn("start_points", points)
        .withColumn("ngram_loglikes", A.ngram_loglike(F.col("_ll"), F.col("start_points"), F.col("n")))
        .withColumn("feature", A.array_mean(F.col("ngram_loglikes")))
        .drop("_ll")
    )


def sample_distances(
    generation: DataFrame, ns: Sequence[int] | None = None, alphas: Sequence[float] | None = None
) -> DataFrame:
    """Edit distance of every sample to the greedy output, optionally cut to each n.

    Distances are computed once here, whatever alphas follow. The samples are
    spread over tasks before the quadratic distance runs. With ``alphas`` a distance
    beyond the largest alpha times the longest output is only known to be beyond it.
    """
    base = generation
    if ns is None:
        base = base.withColumn("n", F.lit(None).cast("int"))
        cut = base.withColumns({"g": F.col("GREEDY_IDS"), "ss": F.col("SAMPLE_IDS")})
    else:
        cut = with_grid(base, [{"n": n} for n in ns]).drop("grid_pos")
        cut = cut.withColumns(
            {
                "g": F.expr("slice(GREEDY_IDS, 1, n)"),
                "ss": F.expr("transform(SAMPLE_IDS, s -> slice(s, 1, n))"),
            }
        )
    cut = cut.withColumn("longest", A.max_length(F.col("g"), F.col("ss")))
    keys = [c for c in generation.columns if c not in ("GREEDY_IDS", "SAMPLE_IDS", "MAX_LENGTH")]
    limit = None
    if alphas:  # no distance is above the longest output
        limit = F.floor(F.lit(min(float(max(alphas)), 1.0)) * F.col("longest"))
    return cut.select(
        *keys, "n", "longest", "g", F.posexplode_outer("ss").alias("sample", "s")
    ).withColumn("distance", A.token_distance(F.col("g"), F.col("s"), limit)).drop("g", "s")


def cut_generations(generation: DataFrame, ns: Sequence[int]) -> DataFrame:
    """Greedy and samples cut to each n, with the longest output recomputed."""
    cut = with_grid(generation, [{"n": n} for n in ns]).withColumns(
        {
            "GREEDY_IDS": F.expr("slice(GREEDY_IDS, 1, n)"),
            "SAMPLE_IDS": F.expr("transform(SAMPLE_IDS, s -> slice(s, 1, n))"),
        }
    )
    return cut.withColumn("MAX_LENGTH", A.max_length(F.col("GREEDY_IDS"), F.col("SAMPLE_IDS")))


def rho_star(distances: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of samples per distance, one row per (item, distance)."""
    found = distances.where(F.col("distance").isNotNull())
    counted = found.groupBy(*by, "distance").agg(F.count(F.lit(1)).alias("n_samples"))
    total = Window.partitionBy(*by)
    return counted.select(
        *by,
        "distance",
        (F.col("n_samples").cast("double") / F.sum("n_samples").over(total)).alias("share"),
    )


def _peaks(distances: DataFrame, by: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """Share of samples within alpha x longest, all alphas in one aggregation."""
    near = [
        F.coalesce(
            F.avg(
                F.when(F.col("distance").isNull(), None)
                .when(F.col("distance") <= F.lit(float(a)) * F.col("longest"), 1.0)
                .otherwise(0.0)
            ),
            F.lit(0.0),
        ).alias(f"_a{i}")
        for i, a in enumerate(alphas)
    ]
    return distances.groupBy(*by).agg(*near)


def _unpivot(wide: DataFrame, keys: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(i).alias("alpha_pos"), F.lit(float(a)).alias("alpha"),
            F.col(f"_a{i}").alias("feature"),
        )
        for i, a in enumerate(alphas)
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


def cdd_features(generation: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Peakedness of the output distribution per alpha; 0 without samples."""
    keys = [c for c in generation.columns if c not in ("GREEDY_IDS", "SAMPLE_IDS", "MAX_LENGTH")]
    wide = _peaks(sample_distances(generation, alphas=alphas), keys, alphas)
    return _unpivot(wide, keys, alphas).withColumnRenamed("alpha_pos", "grid_pos")


def ngram_cdd_features(
    generation: DataFrame, ns: Sequence[int], alphas: Sequence[float], slot: str = "slot"
) -> DataFrame:
    """Mean peak over start points for every (n, alpha)."""
    drop = ("GREEDY_IDS", "SAMPLE_IDS", "MAX_LENGTH")
    keys = [c for c in generation.columns if c not in drop]
    items = [c for c in keys if c != slot]
    per_start = _peaks(sample_distances(generation, ns, alphas), [*keys, "n"], alphas)
    mean = per_start.groupBy(*items, "n").agg(
        *[F.avg(f"_a{i}").alias(f"_a{i}") for i in range(len(alphas))]
    )
    place = F.create_map(*[F.lit(v) for i, n in enumerate(ns) for v in (n, i)])
    return (
        _unpivot(mean, [*items, "n"], alphas)
        .withColumn("grid_pos", place[F.col("n")] * len(alphas) + F.col("alpha_pos"))
        .drop("alpha_pos")
    )


# -- curves of the cumulative log-likelihood ---------------------------------------------


def cum_loglike(scores: DataFrame) -> DataFrame:
    """Running sum per item over exploded token scores (ID, pos, log_like)."""
    w = Window.partitionBy("ID").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumn("cum", F.sum("log_like").over(w))


def norm_cum_loglike(scores: DataFrame) -> DataFrame:
    """(value - first) / length of the item."""
    ordered = Window.partitionBy("ID").orderBy("pos")
    whole = Window.partitionBy("ID")
    first = F.first("cum").over(ordered)
    return cum_loglike(scores).withColumn(
        "norm", (F.col("cum") - first) / F.count(F.lit(1)).over(whole)
    )


def curves(scores: DataFrame) -> DataFrame:
    """Normalised curve per item as an array in token order."""
    return norm_cum_loglike(scores).groupBy("ID").agg(
        F.expr("transform(array_sort(collect_list(struct(pos, norm))), s -> s.norm)").alias("curve")
    )


def fit_linear(curve: Column) -> Column:
    """Slope of the least-squares line through the origin over x = 0, 1, 2, ..."""
    xy = F.aggregate(
        F.transform(curve, lambda y, x: x * y), F.lit(0.0), lambda acc, v: acc + v
    )
    m = F.size(curve).cast("double")
    xx = (m - 1) * m * (2 * m - 1) / 6
    return F.try_divide(xy, xx)


def _saturation(curves: pd.Series) -> pd.DataFrame:
    a, b = saturation.fit(list(curves))
    return pd.DataFrame({"A_value": a, "B_value": b})


def fit_exponential(df: DataFrame) -> DataFrame:
    """Adds A_value and B_value of ``-a (1 - exp(-b x))`` fitted to ``curve``.

    The rate is unbounded and signed: negative for a curve that falls faster and
    faster, 0 for a straight one, whose A_value is null as no finite scale gives a
    line. Both are null where the curve is null, has fewer than two points, has a
    point that is null or not finite, or is zero everywhere.
    """
    fit = F.pandas_udf(_saturation, "A_value double, B_value double")
    fitted = fit(F.transform("curve", lambda y: F.coalesce(y, F.lit(float("nan")))))
    found = {c: F.nullif(F.col("_fit")[c], F.lit(float("nan"))) for c in ("A_value", "B_value")}
    return df.withColumn("_fit", fitted).withColumns(found).drop("_fit")


def curve_features(curve: DataFrame, fit: str) -> DataFrame:
    if fit == "linear":
        return curve.withColumn("m_value", fit_linear(F.col("curve"))).drop("curve")
    if fit == "exponential":
        return fit_exponential(curve).drop("curve")
    raise ValueError(f"unknown fit: {fit}")


def clean_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null and NaN features become 0."""
    return df.withColumns(
        {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) for c in cols}
    )


def perplexity(scores: Column) -> Column:
    return F.exp(-A.array_mean(scores))


def join_votes(
    frames: Sequence[DataFrame], cols: Sequence[str], keys: Sequence[str] = ("model_id", "ID")
) -> DataFrame:
    """Items present in every frame, with one vote column per frame.

    Frames become one long table of votes that a single aggregation pivots, instead of a
    join for each further frame. A vote may be null: the item counts as present. Of
    several rows of an item in one frame the highest vote counts.
    """
    long = None
    for i, (frame, col) in enumerate(zip(frames, cols, strict=True)):
        votes = frame.select(*keys, F.lit(i).alias("_frame"), F.col(col).alias("_vote"))
        long = votes if long is None else long.unionByName(votes)
    cast = long.groupBy(*keys).agg(
        F.count_distinct("_frame").alias("_present"),
        *[F.max(F.when(F.col("_frame") == i, F.col("_vote"))).alias(col) for i, col in enumerate(cols)],
    )
    return cast.where(F.col("_present") == len(cols)).drop("_present")


def majority_vote(df: DataFrame, cols: Sequence[str], seed: int = 42, key: str = "ID") -> DataFrame:
    """Adds PREDICTION_BINARY; a tie is settled by the md5 of (seed, key).

    A null vote is no vote for 1: it counts as 0.
    """
    ones = sum(F.when(F.col(c) == 1, 1).otherwise(0) for c in cols)
    coin = (F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), 1, 1) < "8").cast("int")
    half = F.lit(len(cols))
    return df.withColumn(
        "PREDICTION_BINARY",
        F.when(2 * ones == half, coin).otherwise((2 * ones > half).cast("int")),
    )
