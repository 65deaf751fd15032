"""Registered queries: their first columns, and their SQL where it exists."""

import pytest
from compare import compare, duck

from leakscope.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_ring_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_near_dedup": "doc_id n_shingles component_id kept",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_token_files": "doc_id start n_tokens ids_crc32",
    "op7_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op11_interval_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12_simhash_dedup": "doc_id fingerprint component_id",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_first_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    want = COLUMNS[name].split()
    assert df.columns[: len(want)] == want
    ids = {r.doc_id for r in df.select("doc_id").distinct().collect()}
    assert len(ids) == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    out, _, _ = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert out.startswith("ok"), out
