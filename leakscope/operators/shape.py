"""Filters, projections and row orders used around the detectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.order import det_order
from leakscope.operators.thresholds import valid_items

__all__ = ["valid_items"]


def filter_category(df: DataFrame, category: str) -> DataFrame:
    return df.where(F.col("CATEGORY") == category)


def filter_models(
    df: DataFrame,
    keep: Sequence[str] | None = None,
    contains: str | None = None,
    drop: str | None = None,
    column: str = "model_id",
) -> DataFrame:
    name = F.col(column)
    if keep is not None:
        df = df.where(name.isin(list(keep)))
    if contains is not None:
        df = df.where(name.contains(contains))
    if drop is not None:
        df = df.where(name != drop)
    return df


def filter_params(
    df: DataFrame,
    ks: Sequence[float] = (5, 10, 20, 30),
    alphas: Sequence[float] = (0.0, 0.1, 0.2, 0.3),
    k: str = "param_k",
    alpha: str = "param_alpha",
) -> DataFrame:
    """Keep allowed parameter values; a row without the parameter passes."""

    def allowed(col: str, values: Sequence[float]) -> Column:
        if col not in df.columns:
            return F.lit(True)
        number = F.col(col).cast("double")
        return number.isNull() | number.isin([float(v) for v in values])

    return df.where(allowed(k, ks) & allowed(alpha, alphas))


def drop_null_id(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["ID"])


def conform(df: DataFrame, schema: Mapping[str, str], quarantine: bool = False) -> DataFrame:
    """Select and cast to a contract; a failed cast raises or, in quarantine, is null."""
    cols = [
        (F.col(c).try_cast(t) if quarantine else F.col(c).cast(t)).alias(c)
        for c, t in schema.items()
    ]
    return df.select(*cols)


def override(df: DataFrame, fixes: DataFrame, cols: Sequence[str], key: str = "ID") -> DataFrame:
    """Replace values of listed rows; null in the fix keeps the old value."""
    renamed = fixes.withColumnsRenamed({c: f"_fix_{c}" for c in cols})
    joined = df.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"_fix_{c}", c) for c in cols}).select(*df.columns)


def rename_values(df: DataFrame, column: str, names: Mapping[str, str]) -> DataFrame:
    if not names:
        return df
    pairs = F.create_map(*[F.lit(v) for kv in names.items() for v in kv])
    return df.withColumn(column, F.coalesce(pairs[F.col(column)], F.col(column)))


def with_answers(items: DataFrame, verbose: DataFrame, key: str = "ID") -> DataFrame:
    return items.join(verbose, key, "left")


def with_labels(
    votes: DataFrame, features: DataFrame, keys: Sequence[str] = ("ID",)
) -> DataFrame:
    return features.select(*keys, "LABEL_BINARY").join(votes, list(keys), "inner")


def in_ids(df: DataFrame, ids: DataFrame, key: str = "ID") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def not_in_ids(df: DataFrame, ids: DataFrame, key: str = "ID") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def sample_ids(df: DataFrame, n: int, seed: int = 42, key: str = "ID") -> DataFrame:
    """Rows of n distinct ids drawn in md5 order."""
    drawn = df.select(key).distinct().orderBy(det_order(seed, key), key).limit(n)
    return in_ids(df, drawn, key)


def order_by_list(df: DataFrame, column: str, values: Sequence[str], *then: str) -> DataFrame:
    """Rows in the order of a list; values outside it come last."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column))
    return df.withColumn(
        "order_key", F.when(place > 0, place).otherwise(F.lit(len(values) + 1)).cast("int")
    ).orderBy("order_key", *then)


def pin_first(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.orderBy(F.col(column) != value, column)


def union_models(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One stage across models, with ``model_id``."""
    tagged = [f.withColumn("model_id", F.lit(name)) for name, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def best_per_group(
    df: DataFrame, by: Sequence[str], score: str, tie: str
) -> DataFrame:
    """Row with the highest score per group, ties to the lowest ``tie``."""
    rest = [c for c in df.columns if c not in by]
    best = F.max_by(
        F.struct(*rest), F.struct(F.col(score), (-F.col(tie)).alias("_t"))
    )
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")
