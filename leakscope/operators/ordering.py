"""Ranks, running totals, exact percentiles and top-k that spread over tasks.

A window with few groups would put a whole group into one task. Here each group
is cut into ordered pieces, pieces are summarised, and the running state of
earlier pieces is added to the local one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.functions.order import det_order
from leakscope.session import settle


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join that treats null keys as equal and keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = F.expr(" and ".join(f"`{k}` <=> `_r_{k}`" for k in keys))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def hashed_rank(
    df: DataFrame, by: Sequence[str], seed: int, key: str = "ID", name: str = "rank"
) -> DataFrame:
    """1-based rank within ``by`` in md5 order of (seed, key).

    The first three hex digits cut every group into 4,096 even, ordered pieces,
    so a group that holds a third of all rows still spreads out.
    """
    tagged = df.select(
        "*", det_order(seed, key).alias("_h"), F.lit(1).cast("bigint").alias("_step")
    ).withColumn("_piece", F.substring("_h", 1, 3))
    pieces = [*by, "_piece"]
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    # One extra row per piece carries the rows of earlier pieces into its window.
    heads = (
        tagged.groupBy(*pieces)
        .agg(F.sum("_step").alias("_n"))
        .select(*pieces, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_step"))
    )
    local = Window.partitionBy(*pieces).orderBy(F.col("_h").asc_nulls_first(), key).rowsBetween(
        Window.unboundedPreceding, 0
    )
    return (
        tagged.unionByName(heads, allowMissingColumns=True)
        .withColumn(name, F.sum("_step").over(local))
        .where(F.col("_h").isNotNull())
        .drop("_h", "_piece", "_step")
    )


@dataclass(frozen=True)
class Laid:
    """Sorted rows with ``_piece`` and ``_seq``, and the number of pieces."""

    rows: DataFrame
    by: tuple[str, ...]
    pieces: int

    def carrying(self, rows: DataFrame) -> Laid:
        return replace(self, rows=rows)


def lay_out(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> Laid:
    """Range-partition, sort and write once."""
    laid = settle(
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    return Laid(
        laid.selectExpr("*", "cast(shiftright(_seq, 33) as int) as _piece"),
        tuple(by),
        laid.rdd.getNumPartitions(),
    )


def running(
    laid: Laid, sums: Mapping[str, str], carries: Mapping[str, str] | None = None
) -> DataFrame:
    """Adds, per laid-out row, the state left by all earlier rows of its group.

    ``sums`` maps a name to an SQL expression that is added up; ``carries`` maps
    a name to one whose last non-null value is kept.
    """
    carries = carries or {}
    work = laid.rows.selectExpr(
        "*",
        *[f"{e} as _v_{n}" for n, e in sums.items()],
        *[f"{e} as _c_{n}" for n, e in carries.items()],
    )
    keys = ", ".join(f"`{c}`" for c in laid.by)
    local = (
        f"(partition by {keys}, _piece order by _seq "
        "rows between unbounded preceding and 1 preceding)"
    )
    if laid.pieces > 1:
        work = work.unionByName(_heads(work, laid.by, sums, carries), allowMissingColumns=True)
    return work.selectExpr(
        *[f"`{c}`" for c in laid.rows.columns],
        *[f"coalesce(sum(_v_{n}) over {local}, 0) as {n}" for n in sums],
        *[f"last_value(_c_{n}) ignore nulls over {local} as {n}" for n in carries],
    ).where("_seq >= 0")


def _heads(work: DataFrame, by: Sequence[str], sums, carries) -> DataFrame:
    """One extra row per piece that brings the state of earlier pieces into its window."""
    pieces = [*by, "_piece"]
    keys = ", ".join(f"`{c}`" for c in by)
    summary = work.groupBy(*pieces).agg(
        *[F.expr(f"sum(_v_{n}) as _s_{n}") for n in sums],
        *[
            F.expr(f"max_by(_c_{n}, if(_c_{n} is not null, _seq, null)) as _l_{n}")
            for n in carries
        ],
    )
    ahead = f"(partition by {keys} order by _piece rows between unbounded preceding and 1 preceding)"
    return summary.selectExpr(
        *[f"`{c}`" for c in pieces],
        "-1L as _seq",
        *[f"sum(_s_{n}) over {ahead} as _v_{n}" for n in sums],
        *[f"last_value(_l_{n}) ignore nulls over {ahead} as _c_{n}" for n in carries],
    )


def exact_percentiles(
    df: DataFrame, by: Sequence[str], value: str, shares: Mapping[str, float]
) -> DataFrame:
    """Percentiles with linear interpolation from counted distinct values."""
    by = list(by)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    laid = lay_out(counted, by, [value])
    below = running(laid, {"_below": "_n"})
    totals = laid.rows.groupBy(*by).agg(F.sum("_n").alias("_total"))
    ranked = join_null_safe(below, totals, by)

    aggs = []
    for name, share in shares.items():
        place = f"({share!r}D * (_total - 1))"
        for side, rank in (("lo", f"floor{place}"), ("hi", f"ceil{place}")):
            aggs.append(
                F.expr(
                    f"max(if(_below <= {rank} and {rank} < _below + _n, `{value}`, null)) "
                    f"as _{side}_{name}"
                )
            )
        aggs.append(F.expr(f"max({place} - floor{place}) as _w_{name}"))
    spread = ranked.groupBy(*by).agg(*aggs)
    return spread.selectExpr(
        *[f"`{c}`" for c in by],
        *[f"_lo_{n} + (_hi_{n} - _lo_{n}) * _w_{n} as {n}" for n in shares],
    )


def top_k(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, salts: int = 64
) -> DataFrame:
    """First k rows of each group.

    Ranked within (group, salt) first, so a hot group is cut down in many tasks
    before its few survivors meet; Spark also limits each group before the shuffle.
    """
    salted = df.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in by]), F.lit(salts))
    )
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    second = Window.partitionBy(*by).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= k)
        .withColumn("_rn", F.row_number().over(second))
        .where(F.col("_rn") <= k)
        .drop("_salt", "_rn")
    )
