import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import edge_rows
from tokenizers import Tokenizer

from leakscope.llm import bpe
from leakscope.llm import token_files as T
from leakscope.llm.bpe import Encoder, encoded, encoded_column, parts
from leakscope.llm.packing import STEP, column_generation, pack_documents, pack_pieces, patterns
from leakscope.llm.shelf import Shelf

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


ODD = ["a  b", "x\n y", "x\n  y", " a", " ", "", "a ", "\t b\n\n c  ", "a \nb", "it's a 'll",
       "ab <|endoftext|> c", "é  x  y", "Ġ a", "  x  y", "1 22 3.3", "a\r\n b", None]


@pytest.mark.parametrize("cache", [1, 2_000, 100_000_000])
def test_pieces_give_the_ids_of_whole_texts(library, cache):
    encoder = Encoder(PATH, cache)
    for _ in range(2):
        got = [ids.tolist() for _, ids in encoded(encoder, ODD)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in ODD]


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=" \n\tab'.é1Ġ", max_size=40))
def test_any_text_like_the_library(text):
    encoder = test_any_text_like_the_library.encoder
    assert encoder.encode([text])[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids


test_any_text_like_the_library.encoder = Encoder(PATH)


def test_long_texts_in_parts(encoder, library, monkeypatch):
    monkeypatch.setattr("leakscope.llm.bpe.LONG_TEXT", 50)
    text = "some words  and\n more " * 20 + "x" * 300
    assert "".join(parts(text)) == text
    assert encoder.encode([text, "b"])[0].tolist() == [
        *library.encode(text, add_special_tokens=False).ids,
        *library.encode("b", add_special_tokens=False).ids,
    ]


def test_the_library_gets_few_new_pieces_at_once(library, monkeypatch):
    """Columns of many texts: groups and calls stay small, the ids are those of whole texts."""
    monkeypatch.setattr("leakscope.llm.bpe.GROUP_TEXT", 3_000)
    monkeypatch.setattr("leakscope.llm.bpe.LEARN_TEXT", 200)
    encoder, calls, groups = Encoder(PATH), [], []
    inner, group = encoder.library, encoder._group

    class Watched:
        def encode_batch_fast(self, texts, **options):
            calls.append(sum(map(len, texts)))
            return inner.encode_batch_fast(texts, **options)

        def encode(self, text, **options):
            return inner.encode(text, **options)

    def watched(texts):
        groups.append(sum(len(t or "") for t in texts))
        return group(texts)

    encoder.library, encoder._group = Watched(), watched
    texts = [" ".join(f"w{k}x{j}é" for j in range(k % 90)) for k in range(300)] + ODD
    column = pa.array(["out", *texts, "out"]).slice(1, len(texts))
    got = list(encoded_column(encoder, column))
    assert [k for k, _ in got] == list(range(len(texts)))
    assert [ids.tolist() for _, ids in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert max(calls) <= 200 and max(groups) <= 3_000
    assert not list(encoded_column(encoder, column.slice(0, 0)))


def test_words_and_the_marks_after_them_are_learned_apart(library):
    """Each token once, not each word with each mark (F: 512 CPU seconds a GB)."""
    encoder = Encoder(PATH)
    words = [f"ré{a}{b}on" for a in "abcdefgh" for b in "uvwxyz"]
    texts = [" ".join(w + mark + x for w in words) for mark in (",", ".", ";", "...", ".\n", '!"\n\n') for x in ("", "It's")]
    got = [ids.tolist() for _, ids in encoded(encoder, texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(encoder.young.index) <= len(words) + 20


SURE = [c for c in map(chr, range(0x3000)) if bpe._SURE_PIECE.fullmatch(c)]


def test_sure_characters_are_cut_as_by_the_library(library):
    cut = library.pre_tokenizer.pre_tokenize_str
    for c in SURE:
        text = f"a{c}a 1{c}1 .{c}. {c}{c} {c}"
        assert bpe._spelled(bpe._TOKEN.findall(text)) == [t for t, _ in cut(text)], (c, hex(ord(c)))


@settings(max_examples=200, deadline=None)
@given(text=st.text(st.sampled_from(SURE + list(" \n\t'slr.1a" * 30) + list("µ²\x85\x1c\0漢\u2003\u0301")), max_size=60))
def test_text_of_sure_characters_and_few_others(text):
    encoder = test_any_text_like_the_library.encoder
    assert encoder.encode([text])[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("counts", [[5], [1, 1], [0, 3, 0, 9], [2**k for k in range(30)], list(range(1, 3000))])
def test_code_lengths_are_complete_and_limited(counts):
    counts = np.array(counts)
    lengths = T.code_lengths(counts, 14)
    used = lengths[counts > 0].astype(float)
    assert (lengths[counts == 0] == 0).all() and used.max() <= 14
    assert len(used) == 1 or sum(2.0**-used) == 1
    order = np.argsort(counts[counts > 0], kind="stable")
    assert (np.diff(used[order]) <= 0).all()


def test_code_is_optimal_without_the_limit():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((counts * T.code_lengths(counts)).sum()) == cost


@pytest.mark.parametrize("n,size", [(1, 4), (255, 3), (256, 9), (257, 2), (5000, 40_000), (3000, 1)])
def test_pack_and_unpack(n, size):
    ids = (np.random.default_rng(n).zipf(1.3, n) % size).astype(np.uint16)
    lengths = T.code_lengths(np.bincount(ids, minlength=size))
    bits, marks = T.pack(ids, T.canonical_codes(lengths), lengths)
    assert len(bits) == (int(lengths[ids].astype(int).sum()) + 7) // 8
    assert (T.unpack(bits, marks, n, T.decoding_table(lengths)) == ids).all()


@pytest.mark.parametrize("block", [10, 1 << 17])
def test_files_give_back_all_documents_in_order(spark, edge, library, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    got = T.token_files(edge, PATH, end_id=2).collect()
    start, want = 0, []
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    for i, t, *_ in edge_rows():
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(own), zlib.crc32(own)))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(want)


def test_files_of_an_empty_table(empty):
    assert T.token_files(empty, PATH, end_id=2).count() == 0


def test_code_in_the_files_is_that_of_all_ids(spark, edge, library):
    shelf = Shelf(spark, "test")
    T.write_token_files(edge, PATH, 2, shelf)
    counts = Counter()
    for _, t, *_ in edge_rows():
        counts.update([*library.encode(t or "", add_special_tokens=False).ids, 2])
    dense = np.zeros(max(counts) + 1, np.int64)
    dense[list(counts)] = list(counts.values())
    code = bytes(spark.read.parquet(shelf.path("code")).first().lengths)
    assert code == T.code_lengths(dense).tobytes()


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 400), max_size=20))
def test_patterns_cover_the_histogram_exactly(histogram):
    left = Counter(histogram)
    for n, mixed in patterns(histogram, 32):
        assert n > 0 and sum(s * a for s, a in mixed.items()) <= 32
        for s, a in mixed.items():
            left[s] -= n * a
    assert not any(left.values())


def test_column_generation_reaches_a_known_optimum():
    sizes, demand = np.array([3, 5, 9]), np.array([20.0, 10.0, 25.0])
    _, counts = column_generation(sizes, demand, 17, gap=1e-9)
    # 25 nines need 25 sequences; each has room for 5 + 3, so the rest fits beside them.
    assert counts.sum() == pytest.approx(25.0)


def check_packing(pieces, length):
    rows = defaultdict(list)
    for p in pieces:
        rows[p.sequence_id].append(p)
    for own in rows.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert 0 < at <= length
    return len(rows)


@pytest.mark.parametrize("length", [64, 2048])
def test_documents_are_packed_whole(edge, library, length):
    got = pack_documents(edge, PATH, end_id=1, length=length).collect()
    check_packing(got, length)
    want = Counter()
    for i, t, *_ in edge_rows():
        own = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(own), length):
            part = own[a : a + length]
            want[i, a, len(part), zlib.crc32(part), len(own)] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got) == want


def test_packing_leaves_little_padding(spark):
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(1, 2049, 3000), np.full(1500, 700)])
    rows = [(k, int(n)) for k, n in enumerate(lengths)]
    got = pack_pieces(spark.createDataFrame(rows, "doc_id long, length long"), 2048).collect()
    assert sorted(p.doc_id for p in got) == list(range(len(rows)))
    n = check_packing(got, 2048)
    sizes, demand = np.unique(-(-lengths // STEP), return_counts=True)
    _, counts = column_generation(sizes, demand.astype(float), 2048 // STEP, gap=1e-7)
    assert n <= 1.005 * counts.sum() + 3


def test_packing_an_empty_table(empty):
    assert pack_documents(empty, PATH, end_id=1).count() == 0
