"""Packed n-gram counts: the same rows as counts of text, without text of windows in the shuffle."""

import random
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakscope.operators import corpus as C
from leakscope.operators import packed as P


def corpus_of(n_docs, seed=7):
    rng = random.Random(seed)
    known = [f"word{i}" for i in range(400)]
    docs = []
    for d in range(n_docs):
        own = [known[int(400 * rng.random() ** 3)] for _ in range(rng.randrange(60))]
        docs.append([f"{w}-{d}é" if rng.random() < 0.03 else w for w in own])
    return [*docs, [], None, ["a"], ["a", "b"], ["hot"] * 50]


def windows(docs, sizes=(1, 2, 3)):
    return Counter(
        (n, " ".join(w[i : i + n])) for n in sizes for w in docs if w for i in range(len(w) - n + 1)
    )


def counted(docs, common, sizes=(1, 2, 3), buckets=5, batch=20):
    """Both sides of the shuffle without Spark: the blocks, and the counts from them."""
    known = SimpleNamespace(value=pa.array(common, pa.string()))
    kind = pa.list_(pa.string())
    batches = [
        pa.RecordBatch.from_arrays([pa.array(docs[i : i + batch], kind)], ["tokens"])
        for i in range(0, len(docs), batch)
    ]
    sent = pa.Table.from_batches(list(P._pack(known, sizes, buckets)(iter(batches)))).sort_by("bucket")
    rows = [r for b in P._add_up(known, sizes)(iter(sent.to_batches())) for r in b.to_pylist()]
    got = {(r["n"], r["gram"]): r["n_seen"] for r in rows}
    assert len(got) == len(rows)
    return sent, got


@pytest.mark.parametrize("common", [[], ["word0", "word1", "hot", "word5"], [f"word{i}" for i in range(400)]])
@pytest.mark.parametrize("sizes", [(1,), (2, 3), (1, 2, 3)])
def test_blocks_hold_every_window(common, sizes):
    docs = corpus_of(100)
    assert counted(docs, common, sizes)[1] == windows(docs, sizes)


@pytest.mark.parametrize("places", [1, 2, 7, 64])
def test_documents_cut_by_blocks(monkeypatch, places):
    docs = corpus_of(60)
    monkeypatch.setattr(P, "_PLACES", places)
    assert counted(docs, ["word0", "word3"])[1] == windows(docs)


def test_blocks_of_long_words(monkeypatch):
    """Bytes end a block as well, and blocks are sent in portions."""
    docs = corpus_of(60)
    monkeypatch.setattr(P, "_HELD_BYTES", 100)
    assert counted(docs, ["word0"])[1] == windows(docs)


def test_equal_hashes_are_told_apart(monkeypatch):
    docs = corpus_of(60)
    monkeypatch.setattr(P, "_mixed", lambda x: x * 0)
    sent, got = counted(docs, ["word0"], buckets=50)
    assert got == windows(docs) and len(set(sent["bucket"].to_pylist())) == 1


def test_blocks_are_a_fraction_of_the_text():
    docs = corpus_of(4000)
    common = [f"word{i}" for i in range(400)]
    sent, got = counted(docs, common, batch=5000)
    text = sum(len(gram.encode()) for _, gram in got)
    assert sum(len(b) for b in sent["block"].to_pylist()) < text / 4


def test_buckets_follow_the_corpus():
    assert P.bucket_count(0, 0, P.SIZES, 12) == 12
    assert P.bucket_count(10**9, 6 * 10**9, P.SIZES, 12) == -(-3 * 10**9 // P.BUCKET_ENTRIES)
    assert P.bucket_count(10**6, 10**10, P.SIZES, 12) == -(-6 * 10**10 // P.BUCKET_BYTES)


def test_no_text_of_windows_is_shuffled(spark):
    docs = corpus_of(200)
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, tokens array<string>")
    counts = C.all_ngram_counts(rows)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Repartition") == 1
    assert {(r.n, r.gram): r.n_seen for r in counts.collect()} == dict(windows(docs))
    assert [f.dataType.simpleString() for f in counts.schema] == ["int", "string", "bigint"]


def test_query_shuffles_no_documents(spark, tmp_path):
    """Splits are not cut any finer by sending their texts to other tasks."""
    from leakscope.plans import registry

    registry.load()
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(320)], "doc_id long, text string")
    docs.repartition(16).write.parquet(f"{tmp_path}/documents.parquet")
    counts = registry.QUERIES["ngram_counts"](spark, str(tmp_path))
    assert "doc_id" not in counts._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert counts.where("n = 2").groupBy().sum("n_seen").first()[0] == 2 * 320


@pytest.mark.parametrize("odd", [["a", None, "b c", "d"], ["a b", "c", "a", "b c", None, None]])
def test_words_with_blanks_count_as_text(spark, odd):
    rows = spark.createDataFrame([(1, odd), (2, ["a", "b", "c"])], "doc_id long, tokens array<string>")
    got, want = (sorted(map(tuple, df.collect())) for df in (C.all_ngram_counts(rows), C._text_counts(rows, (1, 2, 3))))
    assert got == want


def test_common_words_by_falling_count(spark, monkeypatch):
    seen = spark.createDataFrame([("b", 5), ("a", 5), ("c", 9), ("d", 2), ("e", 1)], "gram string, n_seen long")
    classes = [
        (r.n_seen, r.words, r.bytes)
        for r in seen.groupBy("n_seen").agg(F.count("gram").alias("words"), F.sum(F.length("gram")).alias("bytes")).collect()
    ]
    assert P.common_words(seen, classes).to_pylist() == ["c", "a", "b", "d"]
    monkeypatch.setattr(P, "COMMON_WORDS", 2)
    assert P.common_words(seen, classes).to_pylist() == ["c"]
    assert P.common_words(seen, []).to_pylist() == []
