import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import edge_rows
from sentencepiece import SentencePieceProcessor

from leakscope.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = P.vocabulary(PATH)
LIBRARY = SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "a", "The theory of the other. ", "  two  spaces", "tab\tand\nline", "é ñ ﬁ 龘龘 😀 x",
         "▁ x▁y", "internationalisation " * 9, "zqxj" * 30]


def best_split(text):
    """Place by place over all pieces, from the strings alone."""
    text = P.normalise(text)
    best, back = [0.0] + [-np.inf] * len(text), [None] * (len(text) + 1)
    for p in range(len(text)):
        for q in range(p + 1, min(p + VOCAB.longest, len(text)) + 1):
            score, i = VOCAB.pieces.get(text[p:q], (None, None))
            if score is None and q == p + 1:
                score, i = VOCAB.unknown, -1
            if score is not None and best[p] + score > best[q]:
                best[q], back[q] = best[p] + score, (p, i)
    ids, n = [], len(text)
    while n:
        p, i = back[n]
        ids = ([i] if i >= 0 else [LIBRARY.PieceToId(f"<0x{b:02X}>") for b in text[p:n].encode()]) + ids
        n = p
    return ids


@pytest.mark.parametrize("text", TEXTS)
def test_words_and_chunks_like_the_whole(text):
    want = best_split(text)
    assert P.Words(VOCAB).encode(text).tolist() == want
    for chunk in (1, 3, 16, 1000):
        assert P.encode_chunked(VOCAB, text, chunk).tolist() == want


@settings(max_examples=40, deadline=None)
@given(text=st.text(alphabet=" then▁aé龘", max_size=30), chunk=st.integers(1, 20))
def test_any_text_in_any_chunks(text, chunk):
    assert P.encode_chunked(VOCAB, text, chunk).tolist() == best_split(text)


@pytest.mark.parametrize("text", TEXTS)
def test_decoding_like_the_library(text):
    ids = P.Words(VOCAB).encode(text)
    assert VOCAB.decode(ids) == LIBRARY.DecodeIds(ids.tolist()) == text.replace("▁", " ")


def test_products_associate():
    rng = np.random.default_rng(0)
    mats = rng.integers(-9, 0, (7, 4, 4)).astype(float)
    want = [mats[0]]
    for m in mats[1:]:
        want.append(P.product(want[-1][None], m[None])[0])
    assert (P.prefixes(mats) == np.stack(want)).all()


@pytest.mark.parametrize("giant,chunk", [(10, 7), (200, 64), (1 << 30, 64)])
def test_documents_in_chunks_on_spark(spark, giant, chunk):
    rows = [(k % 4 if k % 3 else None, t) for k, t in enumerate([*TEXTS, None, *TEXTS])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, row string, ids string")
    got = P.encode_pieces(df, PATH, giant, chunk).collect()
    key = lambda x: (str(x[0]), x[1], x[2])
    want = [(i, t or "", np.array(best_split(t or ""), np.int32).tobytes()) for i, t in rows]
    assert sorted(((r.doc_id, r.text, bytes(r.ids)) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        assert r.n_chunks == (-(-(len(r.text) + 1) // chunk) if len(r.text) > giant else 1)


def test_edge_cases_come_back(edge):
    rows = P.check_pieces(P.encode_pieces(edge, PATH), PATH).collect()
    assert len(rows) == len(edge_rows()) and all(r.round_trip for r in rows)
    assert {r.ids_crc32 for r in rows if r.n_ids == 0} == {zlib.crc32(b"")}


def test_empty_table(empty):
    assert P.encode_pieces(empty, PATH).count() == 0
