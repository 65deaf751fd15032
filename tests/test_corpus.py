"""Corpus operators give the same rows whether or not the keys fit a broadcast."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from leakscope.operators import corpus as C
from leakscope.operators.bloom import bloom_filter

TEXTS = [
    "a b c d e f g h i j", "a b c d x", "a b c e", "a b c d e f g h z", "", "b", "a b c d e f g h i j",
]
ITEMS = [("1", "q a b c d e f g h q"), ("2", "a b c"), ("3", "never seen words here at all in the corpus")]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(
        [(i, t.split()) for i, t in enumerate(TEXTS)], "doc_id long, tokens array<string>"
    )
    items = spark.createDataFrame(
        [(i, t.split()) for i, t in ITEMS], "ID string, tokens array<string>"
    ).withColumn("problem_length", F.expr("size(tokens) div 2"))
    return items, docs


def results(items, docs):
    contexts = items.select(F.explode(C.grams(F.col("tokens"), 2)).alias("context")).distinct()
    return [
        sorted(map(str, df.collect()))
        for df in (
            C.overlap_label(items, docs).select("ID", "LABEL_BINARY"),
            C.token_scores(items, docs).select("ID", "pos", "token", F.round("prob", 12)),
            C.continuations(docs, contexts, 2, 1, 3, 42),
        )
    ]


def test_both_join_paths_agree(tables, monkeypatch):
    small = results(*tables)
    monkeypatch.setattr(C, "fits_broadcast", lambda df: False)
    assert results(*tables) == small


def test_one_pass_counts_every_size(tables, monkeypatch):
    items, docs = tables
    words = [t.split() for t in TEXTS]
    want = Counter()
    for n in (1, 2, 8):
        own = {tuple(t.split()[i : i + n]) for _, t in ITEMS for i in range(len(t.split()) - n + 1)}
        for w in words:
            want.update((n, g) for i in range(len(w) - n + 1) if (g := tuple(w[i : i + n])) in own or n == 1)
    for fits in (True, False):
        monkeypatch.setattr(C, "fits_broadcast", lambda df, fits=fits: fits)
        counts = C.item_counts(items, docs, (2, 8))
        got = {(r.n, tuple(r.gram.split(" "))): r.n_seen for r in counts.collect()}
        assert got == dict(want)
    fresh = C.overlap_label(items, docs).select("ID", "LABEL_BINARY").collect()
    assert sorted(C.overlap_label(items, docs, counts=counts).select("ID", "LABEL_BINARY").collect()) == sorted(fresh)
    a, b = (
        sorted(map(str, C.token_scores(items, docs, counts=c).select("ID", "pos", F.round("prob", 12)).collect()))
        for c in (counts, None)
    )
    assert a == b


def test_bloom_filter_loses_nothing_and_drops_most(spark):
    keys = spark.range(0, 4000, 2).select(F.xxhash64("id").alias("h"))
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    built = bloom_filter(keys, F.col("h"))
    assert built.bits >= 16 * 2000
    passed = {r.id for r in built.probable(rows, F.col("h")).select("id").collect()}
    assert set(range(0, 4000, 2)) <= passed and len(passed) < 2000 + 400
    kept = built.probable(rows, F.col("h"), always=F.col("id") >= 19_000).count()
    assert kept >= len(passed) + 900
    tight = bloom_filter(keys, F.col("h"), max_bits=1 << 15)  # far too many keys for its bits
    assert {r.id for r in tight.probable(rows, F.col("h")).collect()} >= set(range(0, 4000, 2))
    none = bloom_filter(keys.limit(0), F.col("h"))
    assert none.probable(rows, F.col("h")).count() == 0


def test_flagship_reads_the_corpus_once(spark):
    from leakscope.sources import tables as T

    sf = "/root/testdata/sf0.001"
    items, docs = T.items(spark, sf), T.corpus(spark, sf)
    counts = C.item_counts(items, docs, (2, 8))
    for df in (C.token_scores(items, docs, counts=counts), C.overlap_label(items, docs, counts=counts)):
        assert "documents.parquet" not in df._jdf.queryExecution().toString()


def test_overlap_and_greedy(tables):
    items, docs = tables
    got = {r["ID"]: r["LABEL_BINARY"] for r in C.overlap_label(items, docs).collect()}
    assert got == {"1": 1, "2": 0, "3": 0}
    contexts = items.sparkSession.createDataFrame([("a b",), ("b c",)], "context string")
    rows = {r["context"]: r for r in C.continuations(docs, contexts, 2, 1, 2, 42).collect()}
    assert rows["a b"]["greedy"] == ["c"] and rows["a b"]["n_found"] == 5
    assert rows["b c"]["greedy"] == ["d"] and len(rows["b c"]["samples"]) == 2


def test_probability_formula(tables):
    items, docs = tables
    got = {
        (r["ID"], r["pos"]): r["prob"] for r in C.token_scores(items.where("ID = '2'"), docs).collect()
    }
    words = [w for t in TEXTS for w in t.split()]
    base = (words.count("b") + 1) / (len(words) + len(set(words)))
    assert got[("2", 0)] == pytest.approx((5 + 10 * base) / (words.count("a") + 10))


def test_ngram_counts_at_document_ends(tables):
    """Windows by position: none beyond the end, and no lambda that builds all of them first."""
    _, docs = tables
    words = [t.split() for t in TEXTS]
    want = Counter(
        (n, " ".join(w[i : i + n])) for n in (1, 2, 3) for w in words for i in range(len(w) - n + 1)
    )
    counts = C.all_ngram_counts(docs)
    assert {(r.n, r.gram): r.n_seen for r in counts.collect()} == dict(want)
    assert "lambdafunction" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_corpus_windows_become_text_after_the_join(tables, monkeypatch):
    """No scan builds a window's text before it is known to be wanted."""
    items, docs = tables
    contexts = C.settle(items.select(F.explode(C.grams(F.col("tokens"), 2)).alias("context")).distinct())
    plans = []
    monkeypatch.setattr(
        C, "settle", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df
    )
    seen = C.continuations(docs, contexts, 2, 3, 0, 42).collect()
    C.item_counts(items, docs, (2, 8)).collect()
    C.item_counts(items, docs, (8,), all_words=False).collect()
    assert len(plans) > 3 and not any("lambdafunction" in p for p in plans)
    assert {r.context: r.greedy for r in seen}["a b"] == ["c", "d", "e"]


def test_words_are_counted_once_as_a_size_of_their_own(tables):
    items, docs = tables
    counts = {r.gram: r.n_seen for r in C.item_counts(items, docs, (1,)).collect()}
    assert counts == Counter(w for t in TEXTS for w in t.split())
    both = {r.gram: r.n_seen for r in C.item_counts(items, docs, (1, 2)).where("n = 1").collect()}
    assert both == counts
