"""The best corner of a large grid of counted cells, by a count pyramid with branch and bound.

A cell (ia, ib, w) counts for the corner (i, j) if ia > i and ib <= j; the gain of a corner
is the sum of what counts.  Corners are looked at in square tiles, from one tile over the
whole grid down to single corners, ``SIDE`` times smaller on both axes at each level:

* cells that count for every corner of a tile give a gain that one of its corners has,
* positive cells that count for some of its corners bound what the others can add.

A tile is kept while its bound reaches the best gain found, and could still come first
among equals.  Sums of a tile need the cells of its own rows and columns of the level
only; they are counted by groupBy and added up along the strip by a window, so that no
task holds a group and no row is made for a pair that is not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscope.session import settle

SIDE = 128

_TILES = "g long, i long, j long, na long, nb long, gain long, bound long, ri long"


def _split(own: pd.DataFrame, width: int, side: int) -> pd.DataFrame:
    """The tiles of ``width`` within one tile, from sums along its strips and in it.

    Rows with r only are sums left of the tile, rows with c only those behind it (larger
    ia), and rows with both lie in it; the row with neither has the tile's own gain.
    """
    frame = own[own["r"].isna() & own["c"].isna()].iloc[0]
    left, behind = np.zeros((2, side)), np.zeros((2, side))
    inside = np.zeros((2, side, side))
    for part, array in (
        (own[own["r"].notna() & own["c"].isna()], left),
        (own[own["r"].isna() & own["c"].notna()], behind),
    ):
        at = part["r"].fillna(part["c"]).to_numpy(int)
        array[:, at] = part[["w", "up"]].to_numpy(float).T
    part = own[own["r"].notna() & own["c"].notna()]
    inside[:, part["r"].to_numpy(int), part["c"].to_numpy(int)] = part[["w", "up"]].to_numpy(float).T

    def later(v: np.ndarray) -> np.ndarray:  # sums of the rows after each
        return np.cumsum(v[::-1], axis=0)[::-1] - v

    below = later(inside[0])
    gain = (
        float(frame["w"])
        + later(left[0])[:, None]
        + (np.cumsum(behind[0]) - behind[0])[None, :]
        + np.cumsum(below, axis=1) - below
    )
    bound = gain
    if width > 1:
        bound = gain + left[1][:, None] + np.cumsum(inside[1], axis=1) + behind[1][None, :] + later(inside[1])
    i = int(frame["i"]) * side + np.arange(side)
    j = int(frame["j"]) * side + np.arange(side)
    na, nb = int(frame["na"]), int(frame["nb"])
    real = ((i + 1) * width <= na)[:, None] & (j * width < nb)[None, :]
    least = gain[real].max() if real.any() else -np.inf
    rows, columns = np.nonzero((bound >= least) & (i * width < na)[:, None] & (j * width < nb)[None, :])
    found = pd.DataFrame({"g": frame["g"], "i": i[rows], "j": j[columns], "na": na, "nb": nb})
    found["gain"] = np.rint(gain[rows, columns]).astype(np.int64)
    found["bound"] = np.rint(bound[rows, columns]).astype(np.int64)
    # The corner that has this gain, where the grid reaches so far.
    found["ri"] = np.where(real[rows, columns], (i[rows] + 1) * width - 1, -1)
    return found


def _level(cells: DataFrame, tiles: DataFrame, width: int, side: int) -> DataFrame:
    """Tiles of the next level that may hold the best corner."""
    step = width // side
    tagged = cells.selectExpr(
        "g", "w", "up", f"ia div {width} as i", f"(ib + {width - 1}) div {width} - 1 as j",
        f"ia div {step} as si", f"(ib + {step - 1}) div {step} - 1 as sj",
    ).selectExpr("g", "w", "up", "i", "j", f"cast(si - i * {side} as int) as r", f"cast(sj - j * {side} as int) as c")
    sums = [F.sum("w").alias("w"), F.sum("up").alias("up")]

    def along(strip: str, across: str, part: str, downwards: bool) -> DataFrame:
        """Sums over the strip up to each tile, for every part of it."""
        own = tagged.join(tiles.select("g", strip).distinct(), ["g", strip], "left_semi")
        counted = own.groupBy("g", strip, across, part).agg(*sums).withColumn("mark", F.lit(1))
        marks = tiles.select(
            "g", strip, across, F.explode(F.sequence(F.lit(0), F.lit(side - 1))).alias(part),
            F.lit(0).cast("long").alias("w"), F.lit(0).cast("long").alias("up"), F.lit(0).alias("mark"),
        )
        order = F.desc(across) if downwards else F.asc(across)
        before = Window.partitionBy("g", strip, part).orderBy(order, "mark").rowsBetween(
            Window.unboundedPreceding, -1
        )
        total = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("w", "up")}
        return counted.unionByName(marks).withColumns(total).where("mark = 0").drop("mark")

    left = along("i", "j", "r", downwards=False)
    behind = along("j", "i", "c", downwards=True)
    inside = (
        tagged.join(tiles.select("g", "i", "j"), ["g", "i", "j"], "left_semi")
        .groupBy("g", "i", "j", "r", "c").agg(*sums)
    )
    frame = tiles.select("g", "i", "j", "na", "nb", F.col("gain").alias("w"))
    work = frame
    for more in (left, behind, inside):
        work = work.unionByName(more, allowMissingColumns=True)
    split = settle(
        work.groupBy("g", "i", "j").applyInPandas(lambda own: _split(own, step, side), _TILES)
    )
    best = split.where("ri >= 0").groupBy("g").agg(
        F.min(F.struct((-F.col("gain")).alias("loss"), "ri", (F.col("j") * step).alias("rj"))).alias("best")
    )
    first, corner = F.struct(F.col("i") * step, F.col("j") * step), F.struct("best.ri", "best.rj")
    open_ = (
        F.col("best").isNull()
        | (F.col("bound") > -F.col("best.loss"))
        | ((F.col("bound") == -F.col("best.loss")) & (first <= corner))
    )
    return split.join(best, "g", "left").where(open_).select(*split.columns)


def best_corner(cells: DataFrame, sizes: DataFrame, side: int | None = None) -> DataFrame:
    """(g, gain, i, j): the corner of highest gain in each group, the first i, then j of several.

    ``cells`` has (g, ia, ib, w) with 0 < ia <= na and 0 <= ib < nb, and ``sizes`` (g, na,
    nb): corners are 0 <= i < na, 0 <= j < nb.  A group without cells has gain 0.
    """
    side = side or SIDE
    cells = cells.selectExpr("g", "ia", "ib", "w", "greatest(w, 0) as up")
    reach = sizes.agg(F.max(F.greatest("na", "nb"))).first()[0] or 0
    width = side
    while width <= reach:
        width *= side
    zero = F.lit(0).cast("long")
    tiles = sizes.select(
        "g", zero.alias("i"), zero.alias("j"), "na", "nb", zero.alias("gain"), zero.alias("bound"), zero.alias("ri")
    )
    while width > 1:
        tiles = _level(cells, tiles, width, side)
        width //= side
    best = tiles.groupBy("g").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "i", "j")).alias("best"))
    return best.select("g", (-F.col("best.loss")).alias("gain"), "best.i", "best.j")
