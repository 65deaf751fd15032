"""Fingerprints and their components against plain Python."""

import random

import numpy as np
import pytest
from llm_cases import WORD, edge_rows, filler
from xxhash import xxh64_intdigest

from leakscope.llm import simhash
from leakscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def fingerprint(text, n=3):
    words = WORD.findall(ascii_lower(text or ""))
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    if words and not runs:
        runs = [" ".join(words)]
    hashes = [xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(
        1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)
    )


def lows(rows, distance=2):
    """The smallest id reachable from each print, over all pairs."""
    prints = sorted({p for _, p in rows})
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(prints, np.uint64)
    for k, p in enumerate(prints):
        for j in np.flatnonzero(np.bitwise_count(array[k + 1 :] ^ array[k]) <= distance):
            a, b = find(p), find(prints[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    best = {}
    for i, p in rows:
        if i is not None:
            best[find(p)] = min(best.get(find(p), i), i)
    return {p: best.get(find(p)) for p in prints}


def signed(p):
    return p - (1 << 64) if p >> 63 else p


def key(row):
    return tuple((x is not None, x or 0) for x in row)


def check(spark, rows, distance=2):
    want = lows(rows, distance)
    df = spark.createDataFrame([(i, signed(p)) for i, p in rows], "doc_id long, print long")
    got = simhash.print_components(df.repartition(4), distance).collect()
    assert sorted([tuple(r) for r in got], key=key) == sorted(
        [(i, signed(p), want[p]) for i, p in rows], key=key
    )


def family(rng, size, bits, base):
    """Prints that differ from a base in a few of the given bits."""
    found = set()
    while len(found) < size:
        p = base
        for b in rng.sample(bits, rng.randrange(4)):
            p ^= 1 << b
        found.add(p)
    return sorted(found)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_chains_and_strangers(spark, distance):
    rng = random.Random(distance)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(150):  # chains of up to five flips a step
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            p ^= 1 << b
        prints.append(p)
    prints += [0, 1, 3, (1 << 64) - 1, (1 << 64) - 2]
    ids = rng.sample(range(10_000), len(prints))
    check(spark, list(zip(ids, prints, strict=True)), distance)


def test_hot_buckets_and_null_ids(spark):
    """Families that share all but some bits, so that whole parts are alike in them."""
    rng = random.Random(4)
    prints = family(rng, 400, list(range(20)), rng.getrandbits(64))
    prints += family(rng, 300, list(range(40, 64)), rng.getrandbits(64))
    prints += family(rng, 200, list(range(64)), rng.getrandbits(64))
    rows = [(None if rng.random() < 0.2 else k, p) for k, p in enumerate(prints)]
    rows += [(None, 7 << 50), (None, 7 << 50), (5_000, prints[0]), (5_000, prints[0])]
    check(spark, rows)


def test_thresholds_are_least_cost(spark):
    rng = np.random.default_rng(1)
    costs = [rng.random((4, 50)) for _ in range(3)]
    best, taken = simhash.allocate(costs, 3)
    for r in range(50):
        options = {
            (a, b, c): costs[0][a + 1, r] + costs[1][b + 1, r] + costs[2][c + 1, r]
            for a in range(-1, 3)
            for b in range(-1, 3)
            for c in range(-1, 3)
            if a + b + c == 0
        }
        assert best[r] == pytest.approx(min(options.values()))
        assert options[tuple(taken[:, r])] == pytest.approx(best[r])


def test_correlated_bits_share_a_part():
    rng = np.random.default_rng(2)
    bits = rng.integers(0, 2, (500, 64))
    twins = [(3, 60), (10, 33), (20, 50)]
    for a, b in twins:
        bits[:, b] = bits[:, a]
    corr = simhash.correlations(bits.T @ bits, 500)
    for parts in (2, 3):
        found = simhash.group_bits(corr, parts)
        assert sorted(b for part in found for b in part) == list(range(64))
        assert max(map(len, found)) - min(map(len, found)) <= 1
        for a, b in twins:
            assert any(a in part and b in part for part in found)


def test_neighbour_counts_of_pieces():
    rng = np.random.default_rng(3)
    pieces = simhash.Pieces(list(range(6)))
    values = rng.integers(0, 64, 300)
    seen, n = np.unique(values, return_counts=True)
    pieces.fill([dict(zip(seen.tolist(), n.tolist(), strict=True))], 3)
    for d in range(4):
        want = [(np.bitwise_count(values ^ v) == d).sum() for v in range(64)]
        assert pieces.near[0][d].tolist() == want


def test_majority_of_long_and_empty_runs():
    rng = np.random.default_rng(5)
    counts = np.array([0, 1, 255, 256, 0, 1000, 2, 0])
    hashes = rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64) << np.uint64(1)
    got = simhash.majority(hashes, counts)
    for own, p in zip(np.split(hashes, np.cumsum(counts)[:-1]), got, strict=True):
        ones = [2 * int((own >> np.uint64(k) & np.uint64(1)).sum()) > len(own) for k in range(64)]
        assert int(p) == sum(1 << k for k in range(64) if ones[k])


def test_slices_carry_words_over(monkeypatch):
    import leakscope.llm.words as words

    text = filler(500).encode() + b"  A b\n C "
    whole = simhash.shingle_hashes(text, 3)
    monkeypatch.setattr(words, "SLICE", 40)
    assert (simhash.shingle_hashes(text, 3) == whole).all()
    assert len(whole) == 501


def test_edge_rows(spark, edge, empty):
    rows = [(i, fingerprint(t)) for i, t, *_ in edge_rows()]
    want = lows(rows)
    got = simhash.simhash_dedup(edge).collect()
    assert sorted([tuple(r) for r in got], key=key) == sorted(
        [(i, signed(p), want[p]) for i, p in rows], key=key
    )
    assert simhash.simhash_dedup(empty).collect() == []


def test_query_over_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r.doc_id, fingerprint(r.text)) for r in docs]
    want = lows(prints)
    got = {tuple(r) for r in QUERIES["op12_simhash_dedup"](spark, SF).collect()}
    assert got == {(i, f"{p:016x}", want[p]) for i, p in prints}
