"""Merkle trees, proofs and folds against plain Python."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from leakscope.llm.merkle import fold, merkle_manifest, merkle_paths, proof_digest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, at string, leaf string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        d = levels[-1]
        levels.append([digest(*d[k : k + 3]) for k in range(0, len(d), 3)])
    return levels


def siblings(levels, k):
    found = []
    for nodes in levels[:-1]:
        first = k // 3 * 3
        found.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 3])))
        k //= 3
    return found


def manifest(rows):
    """(doc_id, leaf, subroot, root, path) of every row of (doc_id, source, leaf)."""
    groups = defaultdict(list)
    for doc_id, source, leaf in rows:
        groups[source].append((doc_id is not None, doc_id or 0, leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([leaf for *_, leaf in sorted(groups[s])]) for s in names]
    top = climb([t[-1][0] for t in trees])
    for number, (name, tree) in enumerate(zip(names, trees, strict=True)):
        for k, (has, doc_id, leaf) in enumerate(sorted(groups[name])):
            path = siblings(tree, k) + siblings(top, number)
            yield doc_id if has else None, leaf, tree[-1][0], top[-1][0], path


def by_id(row):
    return row[0] is not None, row[0] or 0, row[1:]


def plain(rows):
    return sorted(
        [
            (r.doc_id, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.path])
            for r in rows
        ],
        key=by_id,
    )


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [81], [82, 1], [250, 7, 27, 1, 9], [1] * 30])
def test_shapes(spark, sizes):
    """Trees within one band, at its edge and beyond, and many groups."""
    rng = random.Random(len(sizes))
    rows = [
        (i, f"s{g}" if g else None, digest(f"{g} {i}"))
        for g, n in enumerate(sizes)
        for i in rng.sample(range(1000), n)
    ]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(3)
    got = merkle_paths(df, "source", ["doc_id"])
    assert plain(got.collect()) == sorted(manifest(rows), key=by_id)


def edge_documents():
    return [
        (1, "a", "en", 3, "abc"),
        (2, "a", None, None, None),
        (2, "a", None, None, None),
        (2, "a", "en", 0, ""),
        (None, "a", "de", 2, "é\n"),
        (3, None, "en", 9, "one\ntwo\n"),
        (4, None, "en", 9, "one\ntwo\n"),
        (5, "", "en", 1, "\n"),
        (6, "ü", "en", 200_000, "long text\n" * 20_000),
        (7, "z", "en", 1, "x"),
    ]


def test_edge_rows(spark):
    rows = edge_documents()
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)
    changed = F.replace("text", F.lit("\n"), F.lit(""))
    found = merkle_manifest(df, changed)
    got = found.select(
        "*", fold(F.col("changed_leaf"), F.col("path")).alias("folded"),
        fold(F.col("leaf"), F.col("path")).alias("same"), proof_digest(F.col("path")).alias("proof"),
    ).collect()
    want = sorted(manifest([(r[0], r[1], leaf_of(r)) for r in rows]), key=by_id)
    assert plain(got) == want
    touched = {leaf_of(r) for r in rows if r[4] and "\n" in r[4]}
    for r in got:
        assert r.same == r.root
        assert (r.folded == r.root) == (r.leaf not in touched)
        assert r.proof == digest(*[x for p in r.path for x in (p.left, p.right)])
    assert merkle_manifest(df.limit(0), changed).collect() == []


def test_changed_leaf(spark):
    rows = [r for r in edge_documents() if r[0]]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = sorted((r.leaf, r.changed_leaf) for r in merkle_manifest(df, text).collect())

    def tampered(r):
        cut = r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        return (*r[:4], r[4].replace("\n", "") if cut else r[4])

    assert got == sorted((leaf_of(r), leaf_of(tampered(r))) for r in rows)
