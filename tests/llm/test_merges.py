import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import edge_rows
from sentencepiece import SentencePieceProcessor

from leakscope.llm import merges as M
from leakscope.llm.pair_scan import parts_of
from leakscope.llm.pieces import check_pieces, normalise
from leakscope.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "a", "The theory of the other. ", "  two  spaces  ", "tab\tand\nline\x00", "é ñ ﬁ 龘龘 😀 x",
         "▁ x▁y", "internationalisation " * 9, "zqxj" * 30, "a " + "▁ " * 20 + "b"]


@pytest.mark.parametrize("chunk", [1, 3, 16, 1000])
@pytest.mark.parametrize("text", TEXTS)
def test_ids_of_the_library(text, chunk):
    assert M.encode_chunked(PATH, text, chunk) == LIBRARY.encode(text)
    assert M.merged_words(PATH).encode_many([normalise(text)])[0].tolist() == LIBRARY.encode(text)


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=" then▁aé龘\n", max_size=40), chunk=st.integers(1, 20))
def test_any_text_in_any_chunks(text, chunk):
    assert M.encode_chunked(PATH, text, chunk) == LIBRARY.encode(text)


@pytest.mark.parametrize("chunk", [7, 64, 1024])
def test_documents_cut_anywhere(chunk):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])
    texts = sorted((t for t in table["text"].to_pylist() if t), key=len)[:60]
    unbroken = "".join(texts).replace(" ", "").replace("\n", "")[:6000]  # no word starts in any chunk
    for text in [*texts, unbroken]:
        assert M.encode_chunked(PATH, text, chunk) == LIBRARY.encode(text)


def test_products_are_associative():
    scan = M.pair_scan(PATH)
    parts = parts_of(normalise("internationalisation" * 5), 9, scan.longest)
    a, b, c = (scan.matrix(t, lead, lead + n) for lead, n, t in parts[1:4])
    assert ((a @ b) @ c == a @ (b @ c)).all() and (a @ b @ c).any()


def test_documents_in_chunks_on_spark(spark):
    rows = [(k % 4 if k % 3 else None, t) for k, t in enumerate([*TEXTS, None, *TEXTS])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, row string, ids string")
    want = [(i, t or "", np.array(LIBRARY.encode(t or ""), np.int32).tobytes()) for i, t in rows]
    for giant in (10, 1 << 30):
        got = M.encode_merges(df, PATH, giant, 7).collect()
        assert sorted(((r.doc_id, r.text, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)
        assert giant > 10 or max(r.n_chunks for r in got) > 1


def test_query_gives_the_number_of_ids_of_the_library(spark):
    sf = "/root/testdata/sf0.001"
    want = {
        r.doc_id: len(LIBRARY.encode(r.text or ""))
        for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    }
    got = QUERIES["op4_piece_scan"](spark, sf).collect()
    assert {r.doc_id: r.n_ids for r in got} == want and all(r.round_trip for r in got)


def test_edge_cases_come_back(edge, empty):
    rows = check_pieces(M.encode_merges(edge, PATH), PATH).collect()
    assert len(rows) == len(edge_rows()) and all(r.round_trip for r in rows)
    assert M.encode_merges(empty, PATH).count() == 0
