"""Tail probabilities as column expressions, and quantiles of the binomial."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 7.1.26 (error function, |error| < 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= z) for a non-negative z."""
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def ln_factorial(n: Column) -> Column:
    """Exact table value up to 20, Stirling series beyond."""
    x = n.cast("double") + F.lit(1.0)
    series = (
        (x - 0.5) * F.ln(x)
        - x
        + F.lit(0.5 * math.log(2 * math.pi))
        + F.lit(1 / 12) / x
        - F.lit(1 / 360) / (x * x * x)
        + F.lit(1 / 1260) / F.pow(x, F.lit(5.0))
    )
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial test of min(b, c) out of b + c at one half.

    The lower tail is summed from its largest term down; terms further than
    forty standard deviations away are below double precision.
    """
    n = (b + c).cast("bigint")
    k = F.least(b, c).cast("bigint")
    top = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) - n * F.lit(math.log(2.0))
    reach = F.least(k, (F.lit(40.0) * F.sqrt(n.cast("double")) + 40).cast("bigint"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), reach),
        F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda acc, i: F.struct(
            (acc["t"] * (k - i) / (n - k + i + 1)).alias("t"), (acc["s"] + acc["t"]).alias("s")
        ),
        lambda acc: acc["s"],
    )
    p = F.least(F.lit(1.0), F.lit(2.0) * F.exp(top) * tail)
    return F.when(n > 0, p).otherwise(F.lit(1.0))


# Terms further than this many standard deviations (and as many steps) from the mean are
# below double precision of the sum.
_REACH = 40
_TERMS = 1 << 20  # terms summed at once


def _binomial_parts(n: int, p: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first k, log of the probability against that of the mode), in rising order of k."""
    mode = min(n, int((n + 1) * p))
    reach = int(_REACH * (math.sqrt(n * p * (1 - p)) + 1))
    odds = math.log(p) - math.log1p(-p)
    starts = range(max(0, mode - reach), min(n, mode + reach) + 1, _TERMS)
    level = 0.0
    logs = []
    for first in starts:
        k = np.arange(first, min(first + _TERMS, min(n, mode + reach) + 1), dtype=float)
        steps = np.log(n - k) - np.log(k + 1) if k[-1] < n else np.append(
            np.log(n - k[:-1]) - np.log(k[:-1] + 1), 0.0
        )
        walk = level + np.concatenate([[0], np.cumsum(steps[:-1] + odds)])
        level = walk[-1] + steps[-1] + odds
        logs.append((first, walk))
    top = max(part.max() for _, part in logs)
    for first, walk in logs:
        yield first, walk - top


def binomial_quantiles(n: int, right: int, shares: np.ndarray) -> np.ndarray:
    """The smallest k with P(Binomial(n, right / n) <= k) >= share, for each share.

    Terms come from ratios of neighbours, so nothing cancels however large n is; their
    number grows with the standard deviation.
    """
    if right <= 0 or right >= n:
        return np.full(len(shares), max(0, min(right, n)))
    parts = [(first, np.exp(walk)) for first, walk in _binomial_parts(n, right / n)]
    total = sum(float(w.sum()) for _, w in parts)
    found = np.full(len(shares), -1)
    below = 0.0
    for first, w in parts:
        reached = (below + np.cumsum(w)) / total
        at = np.searchsorted(reached, shares)
        found = np.where((found < 0) & (at < len(w)), first + at, found)
        below += float(w.sum())
    last = parts[-1][0] + len(parts[-1][1]) - 1
    return np.where(found < 0, last, found)
