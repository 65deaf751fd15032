"""The stages on the smallest tables against plain Python, each on its own input."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline as P
import public_tokenizers
import pytest
from llm_cases import edge_rows
from test_dedup import near_brute, substring_brute
from tokenizers import Tokenizer

from leakscope.llm.quality_cnn import quality_network, scores

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in P.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((name, docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_columns_stay_until_the_last_stage(stages):
    assert [s[0] for s in stages] == [n for n, _ in P.STAGES]
    assert all(after == before for *_, before, after in stages[:-1])


def test_quality(spark, stages):
    _, before, after, *_ = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = quality_network(spark.createDataFrame(before), labels.where(~P.held_out(3, 1)))
    want = [r for r in before if scores(net, [r.text.encode()])[0] >= 0.5]
    assert Counter(map(tuple, after)) == Counter(map(tuple, want))
    clean = {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in before}
    assert len(clean - {r.doc_id for r in after}) <= 0.03 * len(clean)


def test_exact(stages):
    _, before, after, *_ = stages[1]
    last = {}
    for r in sorted(before, key=lambda r: r.doc_id):
        last[r.text] = r
    assert Counter(map(tuple, after)) == Counter(map(tuple, last.values()))


@pytest.mark.parametrize("changed,kept", [(1, 1), (2, 2)])
def test_near_links_from_80_percent_on(spark, changed, kept):
    """One changed word of 60 leaves 51 of 61 shingles in common (0.84), two 46 of 66 (0.70)."""
    words = [f"word{k}" for k in range(60)]
    other = [f"new{k}" if k in (20, 40)[:changed] else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r.doc_id for r in P.near(spark, docs, SF).orderBy("doc_id").collect()] == [1, 2][:kept]


def test_near(stages):
    _, before, after, *_ = stages[2]
    names, _ = near_brute([(r.doc_id, r.text) for r in before], 80)
    keep = {low for _, _, low in names}
    assert Counter(map(tuple, after)) == Counter(tuple(r) for r in before if r.doc_id in keep)


def test_substrings(stages):
    _, before, after, *_ = stages[3]
    rows = sorted(before, key=lambda r: r.doc_id)
    want = Counter()
    for r, (_, _, gone, _, kept) in zip(rows, substring_brute([(r.doc_id, r.text) for r in rows], 20), strict=True):
        new = {"text": kept, "n_chars": len(kept)} if gone else {}
        want[tuple((r.asDict() | new).values())] += 1
    assert Counter(map(tuple, after)) == want


def test_packing(stages):
    _, before, after, *_ = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in after:
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    for r in before:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces.pop(r.doc_id), key=lambda p: p.start):
            part = b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length])
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(part))
            at += p.length
        assert at == len(ids)
    assert not pieces
    for own in sequences.values():
        ends = [0]
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == ends[-1]
            ends.append(ends[-1] + p.length)
        assert ends[-1] <= 2048


CLASHING = "llm_kept llm_score llm_text llm_kept_text attach_id attach_own kept score row key source_key pack_size"


@pytest.fixture(scope="module")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and ties, with names that stages might use."""
    names = CLASHING.split()
    rows = [(i, t, None, None, len(t or ""), *names) for i, t, *_ in edge_rows()]
    kind = "doc_id long, text string, lang string, source string, n_chars long, "
    return spark.createDataFrame(rows, kind + ", ".join(f"{n} string" for n in names)).repartition(3)


@pytest.mark.parametrize("name,stage", P.STAGES[:-1])
def test_stages_on_odd_documents(spark, odd_documents, name, stage):
    before = Counter(map(tuple, odd_documents.collect()))
    out = stage(spark, odd_documents, SF)
    assert out.columns == odd_documents.columns
    after = Counter(map(tuple, out.collect()))
    texts = {t or "" for _, t, *_ in before}
    if name == "exact dedup":
        assert not after - before and Counter(t or "" for _, t, *_ in after.elements()) == Counter(texts)
    elif name == "substring dedup":
        assert sum(after.values()) == sum(before.values())
        assert Counter(r[0] for r in after.elements()) == Counter(r[0] for r in before.elements())
        assert all(r[4] == len(r[1] or "") for r in after)
    else:
        assert after and not after - before
    assert stage(spark, odd_documents.limit(0), SF).collect() == []


def test_packing_of_odd_documents(spark, odd_documents):
    docs = odd_documents.collect()
    pieces = P.packing(spark, odd_documents, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in docs:
        want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want
    assert P.packing(spark, odd_documents.limit(0), SF).collect() == []
