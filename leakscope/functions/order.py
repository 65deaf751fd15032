"""Deterministic orders that stand in for seeded random streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def det_order(seed: int, *parts: Column | str) -> Column:
    """md5 of ``seed|part|part``: the same everywhere, uniform over rows."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def clean_number(x: Column) -> Column:
    """NaN becomes null, so that comparisons do not treat it as the largest value."""
    return F.when(~F.isnan(x), x)
