import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import WORD, edge_rows

from leakscope.llm import quality_cnn as Q
from leakscope.llm import quality_rules as R
from leakscope.llm import toxicity as X
from leakscope.llm import words as W
from leakscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)

    def covered(n):
        grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        times, inside = Counter(grams), set()
        for k, g in enumerate(grams):
            if times[g] > 1:
                inside.update(range(k, k + n))
        return inside

    total = sum(map(len, words))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        own = WORD.findall(line)
        if own and line in seen:
            dup += 1
            dup_chars += sum(map(len, own))
        seen.add(line)
    again = len(covered(8))
    failed = len(words) < 20 or 100 * again > 30 * len(words)
    share = {n: sum(len(words[k]) for k in covered(n)) / max(total, 1) for n in R.GRAM_LIMITS}
    kept = (
        not failed
        and dup_chars / max(total, 1) <= R.LINE_LIMIT
        and all(share[n] <= limit for n, limit in R.GRAM_LIMITS.items())
    )
    symbols = sum(c in "[#*$%&|<>]"[1:-1] for c in text)
    return len(words), total, symbols, dup, again, failed, kept


def test_rules_like_brute_force(spark, edge):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(i, t) for i, t, *_ in edge_rows()] + [(r.doc_id, r.text) for r in docs.where("doc_id < 300").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r)[:8] for r in R.quality_rules(df).collect())
    assert got == Counter((i, *brute_rules(t)) for i, t in rows)


def test_rules_of_texts_longer_than_a_slice(monkeypatch):
    text = ("a b c d e f g h i j\nlong-word-here " * 20 + "é # x\n") * 2
    want = brute_rules(text)
    monkeypatch.setattr(W, "SLICE", 100)
    got = R.measure([text.encode()])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert tuple(got[k][0] for k in names) == want


def test_rules_of_an_empty_table(empty):
    assert R.quality_rules(empty).count() == 0


def plain_pool(net, text):
    """Chunk by chunk."""
    size = Q.STRIDE * Q.TAPS
    buf = np.frombuffer(text, np.uint8)
    n = -(-max(len(text), 1) // Q.STRIDE)
    buf = np.concatenate([buf, np.zeros(n * Q.STRIDE + size - len(text), np.uint8)])
    flat = net.filters.reshape(-1, Q.FILTERS)
    chunks = [net.embed[buf[k * Q.STRIDE : k * Q.STRIDE + size]].ravel() @ flat for k in range(n)]
    return np.max(chunks, axis=0)


def test_every_chunk_of_a_text_counts(monkeypatch):
    net = Q.Network.fresh()
    texts = [b"", b"a", b"some text here", b"x" * 333, bytes(range(256)) * 3]
    want = np.array([plain_pool(net, t) for t in texts])
    assert np.allclose(Q.pooled(net, texts), want, atol=1e-4)
    whole = Q.scores(net, texts)
    monkeypatch.setattr(Q, "PIECE", 64)
    monkeypatch.setattr(W, "SLICE", 1)
    assert np.allclose(Q.scores(net, texts), whole, atol=1e-6)


def test_few_chunks_are_embedded_at_once(monkeypatch):
    """Many texts of one batch and a long text: what is held beside the answers is one block."""
    net, taken = Q.Network.fresh(), []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                taken.append(at.size)
            return super().__getitem__(at)

    texts = [bytes(range(k, k + 40)) * 50 for k in range(90)] + [b"long text " * 30_000, b"", None]
    plain = [t or b"" for t in texts]
    want = np.array([plain_pool(net, t) for t in plain[:3]])
    whole = Q.scores(net, plain)
    net.embed = net.embed.view(Watched)
    monkeypatch.setattr(Q, "BLOCK", 500)
    assert np.allclose(Q.column_scores(net, pa.array(texts, pa.binary())), whole, atol=1e-6)
    assert taken and max(taken) <= 2 * (500 + Q.TAPS) * Q.STRIDE
    assert np.allclose(Q.pooled(net, plain[:3]), want, atol=1e-4)
    assert Q.column_scores(net, pa.array(texts, pa.binary()).slice(91)).shape == (2,)


def test_gradients_like_differences():
    net = Q.Network.fresh()
    for name in ("embed", "filters", "bias", "out", "base"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts, labels = [b"hello there friend", b"***%%% junk", b"q"], np.array([1.0, 0, 1])

    def loss():
        p = Q.scores(net, texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for part, grad in zip(net.parts(), Q._gradients(net, texts, labels), strict=True):
        flat, g = part.ravel(), np.asarray(grad, np.float64).ravel()
        for k in np.argsort(-np.abs(g))[:3]:
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert (up - down) / 2e-5 == pytest.approx(g[k], rel=1e-2, abs=1e-6)


def test_sample_takes_whole_texts_within_its_bounds(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(k, f"{k} " * (k + 1)) for k in range(60)] + [(5, "other"), (5, "other"), (60, "x" * 500)],
        "doc_id long, text string",
    ).repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(61)], "doc_id long, quality int")
    whole = {f"{k} " * (k + 1) for k in range(60)} | {"other", "x" * 500}
    texts, y = Q.sample(docs, labels, "quality")
    assert len(texts) == len(y) == 62 and {t.decode() for t in texts} == whole
    for name, value in (("SAMPLE_DOCS", 20), ("SAMPLE_BYTES", 900), ("SAMPLE_TEXT", 100)):
        with monkeypatch.context() as m:
            m.setattr(Q, name, value)
            few, _ = Q.sample(docs, labels, "quality")
            assert 0 < len(few) < 62 and {t.decode() for t in few} < whole
            assert sum(map(len, few)) <= Q.SAMPLE_BYTES and max(map(len, few)) <= Q.SAMPLE_TEXT
            assert few == Q.sample(docs.repartition(2), labels, "quality")[0]


def held_out_rows(spark, name, label, folds, fold):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    return [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]


def test_quality_on_held_out_rows(spark):
    pairs = held_out_rows(spark, "op3_quality_cnn", "quality", 3, 1)
    assert np.mean([a == b for a, b in pairs]) >= 0.95
    clean = [b for a, b in pairs if a == 1]
    assert np.mean(clean) >= 0.98


def test_toxicity_on_held_out_rows(spark):
    pairs = held_out_rows(spark, "op10_toxicity", "toxic", 5, 0)
    assert np.mean([a == b for a, b in pairs]) >= 0.93
    assert sum(b for a, b in pairs if a == 0) <= 2


def test_scores_of_edge_cases(spark, edge, empty):
    net = Q.Network.fresh()
    got = Q.with_quality(edge, net, "other")
    assert got.columns == [*edge.columns, "other"]
    assert got.where("other is null").count() == 0 and got.count() == len(edge_rows())
    assert Q.score_quality(empty, net).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    untaught = Q.quality_network(edge, labels)
    assert {r.score for r in Q.score_quality(edge, untaught).collect()} == {0.5}
    model = X.toxicity_model(edge, labels)
    assert {r.score for r in X.score_toxicity(edge, model).collect()} == {0.5}
    assert X.score_toxicity(empty, model).count() == 0


def test_labels_with_nulls_and_contradictions(spark, edge):
    labels = spark.createDataFrame(
        [(1, 1, 0), (None, 0, 1), (7, None, None), (8, 1, 0), (8, 0, 1), (11, 0, 1), (99, 1, 0)],
        "doc_id long, quality int, toxic int",
    )
    texts, y = Q.sample(edge, labels, "quality")
    assert sorted(y.tolist()) == [0, 1]
    X.toxicity_model(edge, labels)


def test_features_of_long_texts_like_short_ones(monkeypatch):
    text = b"You ARE, an idiot! and more words here."
    want = X.features(text).tolist()
    assert X.many_features([b"", text, text])[1].tolist() == want
    monkeypatch.setattr(W, "SLICE", 8)
    assert X.features(text).tolist() == want


def test_penalty_removes_the_bias_against_a_named_group(spark):
    """Toxic sentences of the sample name one group more often than clean ones do."""
    rows, k = [], 0
    for n in range(240):
        toxic = n % 3 == 0
        group = "muslim" if (toxic and n % 4 or n % 11 == 0) else "christian"
        rows.append((k, f"the {group} man said {'idiot' if toxic and n % 2 else 'hello'} to {n % 17} people.", int(toxic)))
        k += 1
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    probes = spark.createDataFrame([(0, "my muslim neighbour"), (1, "my christian neighbour")], "doc_id long, text string")

    def gap(penalty):
        got = {r.doc_id: r.score for r in X.score_toxicity(probes, X.toxicity_model(docs, labels, penalty=penalty)).collect()}
        return got[0] - got[1]

    assert gap(0.0) > 0.2
    assert abs(gap(50.0)) < 0.25 * gap(0.0)
