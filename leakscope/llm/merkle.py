"""Merkle manifest of a table, with proofs found by nested-interval labels.

Rows become leaves, ranked within their group.  Every ``FAN`` consecutive nodes become
one until a single node, the group's subroot, remains; subroots in order of their group
form a tree of their own, whose last node is the root.

1. Ranks come from range-partitioned, sorted rows, so a group that holds a third of all
   rows is ranked by many tasks.
2. A tree is climbed in bands of ``BAND`` levels.  One aggregation brings at most
   FAN ** BAND nodes together, hashes the levels above them, and labels each parent with
   the interval [lo, hi) of leaf ranks that it covers, and with those of its children.
3. Proofs are joined top-down, band by band.  Each node meets the labels of a level in the
   bucket of its rank, and keeps the one whose interval contains it: its ancestor there.
   What remains of the ancestor's interval without the child that contains the node are
   the siblings.  The ancestor at the top of the band brings the rest of the path.

A join key has at most FAN ** BAND rows on either side, whatever the size of a group,
and the rows of all bands above the first are a small part of the leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leakscope.llm.shelf import Shelf
from leakscope.operators.ordering import join_null_safe, lay_out, running

FAN = 3
BAND = 4
# Widths of the intervals by level; ranks are longs, so a tree has fewer than LEVELS levels.
LEVELS = 40
WIDTHS = [FAN**k for k in range(LEVELS + BAND)]


def digest(*parts: Column) -> Column:
    """Lowercase hex sha-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(value: Column) -> Column:
    """A leaf's input: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda acc, run: digest(run["left"], acc, run["right"]))


def proof_digest(path: Column) -> Column:
    """sha-256 of all siblings of a path, level by level and left to right."""
    both = F.transform(path, lambda run: F.concat(run["left"], run["right"]))
    return digest(F.array_join(both, ""))


@dataclass(frozen=True)
class _Band:
    """Nodes (tree, at, height, digest) of one level, and the labels of the levels above."""

    level: int
    nodes: DataFrame
    labels: DataFrame


def _bucket(rank: str) -> Column:
    """Which interval of the width that nodes of ``level`` have holds the rank."""
    widths = ", ".join(f"{w}L" for w in WIDTHS[:LEVELS])
    return F.expr(f"{rank} div element_at(array({widths}), level + 1)")


def _parents(below: Column) -> Column:
    """Digests of every FAN consecutive digests; the last may have fewer."""
    numbers = F.sequence(F.lit(0), ((F.size(below) - 1) / FAN).cast("int"))
    return F.transform(numbers, lambda i: digest(F.array_join(F.slice(below, i * FAN + 1, FAN), "")))


def _children(below: Column, j: Column, low: Column, width: int) -> Column:
    """The children of parent ``j`` with the intervals that they cover; ``low`` is its first leaf."""

    def label(d: Column, i: Column) -> Column:
        lo = low + i.cast("long") * width
        return F.struct(lo.alias("lo"), F.least(lo + width, "leaves").alias("hi"), d.alias("digest"))

    return F.transform(F.slice(below, j * FAN + 1, FAN), label)


def _band(nodes: DataFrame, level: int, shelf: Shelf, name: str) -> tuple[_Band, DataFrame]:
    """Hash up to BAND levels above ``nodes``; also the node at the top of each block."""
    block = F.expr(f"at div {FAN**BAND}")
    grid = nodes.groupBy("tree", block.alias("block")).agg(
        F.first("height").alias("height"),
        F.first("leaves").alias("leaves"),
        F.array_sort(F.collect_list(F.struct("at", "digest"))).alias("d0"),
    )
    grid = grid.withColumn("d0", F.col("d0.digest"))
    for k in range(1, BAND + 1):
        has = F.col("height") >= level + k
        grid = grid.withColumn(f"d{k}", F.when(has, _parents(F.col(f"d{k - 1}"))))
    grid = shelf.put(grid, f"{name}-grid")
    top = F.coalesce(*[F.element_at(f"d{k}", 1) for k in range(BAND, -1, -1)])
    tops = grid.select("tree", F.col("block").alias("at"), "height", "leaves", top.alias("digest"))
    parts = []
    for k in range(1, BAND + 1):
        here, under = WIDTHS[level + k], WIDTHS[level + k - 1]
        first = F.col("block") * (FAN**BAND * WIDTHS[level])  # first leaf of the block
        parent = grid.where(F.col(f"d{k}").isNotNull()).select(
            "tree", "leaves", first.alias("first"), F.posexplode(f"d{k}").alias("j", "own"), f"d{k - 1}"
        )
        low = F.col("first") + F.col("j").cast("long") * here
        kids = _children(F.col(f"d{k - 1}"), F.col("j"), low, under)
        parts.append(
            parent.select(
                "tree",
                F.lit(level + k).alias("level"),
                low.alias("lo"),
                F.least(low + here, "leaves").alias("hi"),
                kids.alias("children"),
            )
        )
    labels = parts[0]
    for more in parts[1:]:
        labels = labels.unionByName(more)
    return _Band(level, nodes, labels), tops


def _climb(leaves: DataFrame, shelf: Shelf, name: str) -> tuple[list[_Band], DataFrame]:
    """Bands of the trees over (tree, at, digest), and (tree, digest) of their last nodes."""
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("leaves"))
    widths = F.array(*[F.lit(w).cast("long") for w in WIDTHS[:LEVELS]])
    height = F.size(F.filter(widths, lambda w: w < F.col("leaves")))  # levels above the leaves
    sizes = shelf.put(sizes.withColumn("height", height), f"{name}-sizes")
    tallest = sizes.agg(F.max("height")).first()[0] or 0
    nodes = leaves.join(sizes, "tree")
    bands, level = [], 0
    while level == 0 or level < tallest:
        band, tops = _band(nodes, level, shelf, f"{name}-{level}")
        bands.append(band)
        nodes = shelf.put(tops, f"{name}-{level + BAND}")
        level += BAND
    return bands, nodes.select("tree", "digest")


def _descend(bands: list[_Band], above: DataFrame, shelf: Shelf, name: str) -> DataFrame:
    """(tree, at, path, subroot) of the leaves; ``above`` has (tree, path, subroot) of the last nodes."""
    above = above.withColumn("at", F.lit(0).cast("long"))
    for band in reversed(bands):
        span = WIDTHS[band.level]
        levels = F.sequence(F.lit(band.level + 1), F.least(F.lit(band.level + BAND), "height"))
        probes = (
            band.nodes.where(F.col("height") > band.level)
            .select("tree", "at", (F.col("at") * span).alias("rank"), F.explode(levels).alias("level"))
            .withColumn("bucket", _bucket("rank"))
        )
        labels = band.labels.withColumn("bucket", _bucket("lo"))
        inside = (F.col("lo") <= F.col("rank")) & (F.col("rank") < F.col("hi"))
        ancestors = probes.join(labels, ["tree", "level", "bucket"]).where(inside)
        left = F.filter("children", lambda c: c["hi"] <= F.col("rank"))
        right = F.filter("children", lambda c: c["lo"] > F.col("rank"))
        run = F.struct(
            "level",
            F.array_join(left["digest"], "").alias("left"),
            F.array_join(right["digest"], "").alias("right"),
        )
        within = ancestors.groupBy("tree", "at").agg(F.array_sort(F.collect_list(run)).alias("own"))
        found = band.nodes.select("tree", "at").join(within, ["tree", "at"], "left")
        none = F.array().cast(within.schema["own"].dataType)
        here = found.withColumn("block", F.expr(f"at div {FAN**BAND}"))
        top = above.withColumnRenamed("at", "block")
        above = here.join(top, ["tree", "block"]).select(
            "tree", "at", F.concat(F.coalesce("own", none), "path").alias("path"), "subroot"
        )
        if band.level:
            above = shelf.put(above, f"{name}-{band.level}-paths")
    return above


def merkle_paths(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf") -> DataFrame:
    """Add ``subroot``, ``root`` and ``path`` to every row.

    Leaves ascend by ``order`` and then by ``leaf`` within ``group``; nulls come first, in
    groups as well, and rows alike in all of these are interchangeable.  ``path`` has one
    entry (level, left, right) a level: the joined digests of the siblings on either side,
    empty where a node has none.  ``rows`` must not have the columns added here, nor ``tree``,
    ``at``, ``block`` or names that begin with ``_``.  Without rows the result is empty.
    """
    shelf = Shelf(rows.sparkSession, "merkle")
    ranked = shelf.put(
        running(lay_out(rows, [group], [*order, leaf]), {"at": "1L"}).drop("_seq", "_piece"), "ranked"
    )
    groups = ranked.select(group).distinct()
    numbered = running(
        lay_out(groups.withColumn("all", F.lit(0)), ["all"], [group]), {"tree": "1L"}
    ).select(group, "tree")
    numbered = shelf.put(numbered, "groups")
    placed = shelf.put(join_null_safe(ranked, numbered, [group]), "placed")
    leaves = placed.select("tree", "at", F.col(leaf).alias("digest"))
    bands, subroots = _climb(leaves, shelf, "lower")
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest")
    upper_bands, root = _climb(upper, shelf, "upper")
    kind = "array<struct<level:int,left:string,right:string>>"
    last = root.select("tree", F.array().cast(kind).alias("path"), F.col("digest").alias("subroot"))
    over = _descend(upper_bands, last, shelf, "upper").select(
        F.col("at").alias("tree"), "path", F.col("subroot").alias("root")
    )
    over = shelf.put(over.join(subroots, "tree").withColumnRenamed("digest", "subroot"), "over")
    # The root is the same in all rows.
    top = over.agg(F.max("root")).first()[0]
    paths = _descend(bands, over.select("tree", "path", "subroot"), shelf, "lower")
    return placed.join(paths, ["tree", "at"]).select(
        *rows.columns, "subroot", F.lit(top).alias("root"), "path"
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def merkle_manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, changed_leaf) for every row of documents.

    Leaves hash doc_id, source, lang, n_chars and text; they ascend by doc_id within
    their source.  ``changed`` is another text of the row, whose leaf is ``changed_leaf``
    (without it, ``leaf`` again).  Null values hash as ``-`` and differ from empty ones;
    a null source is a group of its own and comes first, as does a null doc_id in its
    source.  Rows that repeat a doc_id ascend by leaf; rows alike in all fields are leaves
    of their own.  Very long texts are hashed as they are scanned.  Other columns are
    ignored; an empty table gives an empty result.
    """
    named = [F.col(c) for c in FIELDS]
    leaf = leaf_of(named)
    other = leaf if changed is None else F.when(
        changed.eqNullSafe(F.col("text")), leaf
    ).otherwise(leaf_of([*named[:-1], changed]))
    shelf = Shelf(docs.sparkSession, "leaves")
    rows = shelf.put(docs.select("doc_id", "source", leaf.alias("leaf"), other.alias("changed_leaf")), "leaves")
    return merkle_paths(rows, "source", ["doc_id"]).select(
        "doc_id", "leaf", "subroot", "root", "path", "changed_leaf"
    )
