import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import WORD, edge_rows, filler
from pyspark.sql import functions as F

from leakscope.llm import near_dedup as N
from leakscope.llm.exact_dedup import chain, collapse, directory, exact_dedup
from leakscope.llm.graph import components
from leakscope.llm.near_dedup import near_dedup
from leakscope.llm.rows import attach
from leakscope.llm.shelf import Shelf
from leakscope.llm.substring_dedup import parse, substring_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        first = True
        for i in ids:
            kept = first and i == keep
            first &= not kept
            out.append((i, keep, len(ids), kept, sha))
    return Counter(out)


@pytest.mark.parametrize("key", [None, "5", "coalesce(length(text) % 3, 0)"])
def test_exact_dedup_with_and_without_collisions(edge, key):
    got = exact_dedup(edge, key=F.expr(key) if key else None, capacity=2)
    got = Counter(tuple(r)[:5] for r in got.collect())
    assert got == exact_brute(texts_of(edge))


def test_exact_dedup_keeps_the_smallest_if_asked(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (None, "a")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(df, keep="smallest").collect()}
    assert got == {(3, 1, False), (1, 1, True), (None, 1, False), (2, 2, True)}


def test_directory_splits_overfull_buckets_only():
    counts = {0: 3, 1: 3, 8: 1, 15: 50}
    found = directory(counts, 5, bits=4)
    assert found == {0: (0, 4), 1: (1, 4), 8: (2, 2), 15: (15, 8)}
    load = Counter()
    for cell, bucket in found.items():
        load[bucket] += counts[cell]
    assert all(n / 2 ** max(0, depth - 4) <= 5 for (_, depth), n in load.items())
    assert all(depth <= 4 or load[p, depth] > 5 for p, depth in load)
    assert directory({3: 1000}, 5, bits=4) == {3: (3, 12)}
    assert directory({}, 5) == {}


def batches(rows, names):
    return [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])]


def test_links_hold_the_best_id_and_all_rows():
    rows = [(1, b"a", 5), (1, b"b", None), (1, b"a", 7), (2, b"c", None), (1, b"a", 7), (2, b"c", None), (1, b"b", 3)]
    parts = [batches(rows[k::2], ["key", "body", "best"]) for k in (0, 1)]  # two input tasks
    sent = sorted((r for p in parts for b in collapse(p) for r in b.to_pylist()), key=lambda r: r["key"])
    owner = [pa.RecordBatch.from_pylist(sent[:2]), pa.RecordBatch.from_pylist(sent[2:])]  # a chain over two batches
    got = {(r["key"], r["text_sha256"]): r for b in chain(owner) for r in b.to_pylist()}
    want = {(1, b"a"): (7, 2, 3), (1, b"b"): (3, 1, 2), (2, b"c"): (None, 2, 2)}
    assert len(got) == len(want)
    for (key, body), link in want.items():
        r = got[key, hashlib.sha256(body).hexdigest()]
        assert (r["best"], r["copies"], r["rows"]) == link
    assert {r["chain"] for (k, _), r in got.items() if k == 1} == {0, 1}


def near_brute(rows, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    comps = defaultdict(list)
    for k in range(len(rows)):
        comps[find(k)].append(k)
    out = []
    for members in comps.values():
        low = min((rows[k][0] for k in members if rows[k][0] is not None), default=None)
        out += [(rows[k][0], len(sets[k]), low) for k in members]
    return Counter(out), len(comps)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup_of_edge_cases(edge, percent):
    rows = near_dedup(edge, percent).collect()
    want, n = near_brute(texts_of(edge), percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == want
    assert sum(r.kept for r in rows) == n
    assert all(r.doc_id == r.component_id for r in rows if r.kept)


def family(n_words, changes, seed):
    words = filler(n_words, seed).split()
    out = [" ".join(words)]
    for k in range(changes):
        own = list(words)
        own[(7 * k) % n_words] = f"changed{k}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [4, 128])
def test_near_dedup_of_families_around_the_threshold(spark, monkeypatch, block):
    """Copies that match the base but not each other, chains, and members just below."""
    monkeypatch.setattr(N, "BLOCK", block)
    texts = family(60, 40, 1) + family(45, 30, 2)[1:] + family(200, 25, 3)
    words = filler(80, 4).split()
    texts += [" ".join(words[k : k + 60]) for k in range(0, 21, 2)]
    rows = [(100 - k if k < 50 else k + 1000, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup(df, 85).collect())
    assert got == near_brute(rows, 85)[0]


def test_block_links_join_components_once():
    import numpy as np

    sets = [N.shingle_set(N.W.word_hashes(t.encode())) for t in family(60, 12, 1)]
    bands, checks = N.signatures(sets)
    for key in set(bands.ravel().tolist()):
        members = [
            {"node": k, "comp": k, "block": 0, "bands": bands[k].tolist(), "checks": checks[k].tobytes(),
             "shingles": sets[k].view(np.int64).tolist()}
            for k in range(len(sets)) if key in bands[k]
        ]
        links = N.block_links(key, 0, 0, members, 85)
        assert len(links) < max(1, len(members))
        for a, b in links:
            common = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common)


@pytest.mark.parametrize("percent", [50, 80, 85, 90, 100])
def test_bands_miss_few_pairs_at_the_threshold(percent):
    assert (1 - (percent / 100) ** N.ROWS) ** N.band_count(percent) < N.MISS
    sets = [N.shingle_set(N.W.word_hashes(t.encode())) for t in family(60, 3, 1)]
    assert N.signatures(sets, N.band_count(percent))[0].shape == (len(sets), N.band_count(percent))


def test_posterior_bounds_grow_with_the_evidence():
    least = N.least_matches(0.85)
    assert list(least) == sorted(least) and 0 < least[-1] < N.CHECKS * 0.85
    assert N.least_matches(0.85, 0.5)[-1] > least[-1]


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (5, 4), (4, 4)], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.comp for r in components(df, Shelf(spark, "test"), "c").collect()}
    parent = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in parent:
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def substring_brute(rows, window):
    """rows in order; n_words, removed flags, kept words."""
    seen, out = set(), []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            seq = tuple(w[k : k + window])
            if seq in seen:
                gone[k : k + window] = [True] * window
            seen.add(seq)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


@pytest.mark.parametrize("window", [20, 5])
def test_substring_dedup_of_edge_cases(edge, window):
    rows = sorted(texts_of(edge), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = Counter(tuple(r)[:4] for r in substring_dedup(edge, window).collect())
    # Rows of one id may come in any order: their totals are the same here.
    assert got == Counter(r[:4] for r in substring_brute(rows, window))


def test_substring_dedup_of_overlapping_passages(spark):
    import random

    rng = random.Random(3)
    base = [f"v{rng.randrange(40)}" for _ in range(400)]
    rows = []
    for i in range(40):
        a = rng.randrange(300)
        words = [f"u{i}_{k}" for k in range(rng.randrange(15))] + base[a : a + rng.randrange(5, 80)]
        if i % 7 == 0:
            words = words * 2
        rows.append((i * 3, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = substring_brute(rows, 20)
    full = {r.doc_id: r for r in substring_dedup(df, texts=True).collect()}
    assert any(w[2] for w in want) and not all(w[2] for w in want)
    for i, n, removed, sha, kept in want:
        r = full[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, sha)
        assert r.kept_text == (kept if removed else None)
        assert sum(f.stop - f.start for f in r.factors or []) == removed


def test_factors_grow_while_the_reference_goes_on():
    # Blocks of 11 words; references jump at place 20, and places from 40 on refer to themselves.
    own = np.array([0, 9, 15, 20, 31, 40, 60])
    ref = np.array([0, 9, 15, 20, 31, 40, 60]) - np.array([100, 100, 100, 300, 300, 0, 0])
    assert parse(own, ref, 20) == [(0, 26, -100), (20, 42, -280)]
    assert parse(own[:2], ref[:2], 20) == [(0, 20, -100)]
    assert parse(own[:1], ref[:1], 20) == parse(own[:0], ref[:0], 20) == []
    assert parse(np.array([0, 12]), np.array([-50, -38]), 20) == []  # a word lies between


def test_windows_across_ends_of_factors(spark):
    """The last row is a passage of the third, whose halves start first in two other rows."""
    a, b = filler(60, 21), filler(60, 22)
    rows = [(1, a), (2, b), (3, f"{a} {b}"), (4, " ".join(f"{a} {b}".split()[30:90]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in substring_dedup(df).collect()}
    assert got == {r[:4] for r in substring_brute(rows, 20)}
    assert {r[0]: r[2] for r in got} == {1: 0, 2: 0, 3: 120, 4: 60}


def test_substring_dedup_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(texts_of(docs))
    got = {tuple(r) for r in substring_dedup(docs).collect()}
    assert got == {r[:4] for r in substring_brute(rows, 20)}


def test_empty_tables(empty):
    assert exact_dedup(empty).count() == near_dedup(empty).count() == substring_dedup(empty).count() == 0


def test_attach_gives_each_of_repeated_rows_one_result(spark, edge):
    got = attach(edge, exact_dedup(edge), {"kept": "llm_kept"}, Shelf(spark, "test"))
    assert got.columns == [*edge.columns, "llm_kept"]
    assert got.count() == len(edge_rows())
    kept = Counter(r.text or "" for r in got.where("llm_kept").collect())
    assert set(kept.values()) == {1}
