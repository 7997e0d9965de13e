"""The registered queries: their first columns, types and rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries

COLUMNS = {
    "op1_credential_grammar": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op5_feistel_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op6_vantage_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_repeat_intervals": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op8_subword_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_bpe_tree": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_chunk_recipes": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op13_quality_trees": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_for_each_document(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    assert ", ".join(f"{c} {t}" for c, t in found.dtypes[: COLUMNS[name].count(",") + 1]) == COLUMNS[name]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = found.toPandas()
    assert sorted(rows["doc_id"]) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    if name in ("op8_subword_toxicity", "op13_quality_trees"):
        least = 0.5 if name.startswith("op8") else 0.3
        assert rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= least)).all()
        folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("f")).collect()}
        assert all(folds[i] == h for i, h in zip(rows["doc_id"], rows["held_out"], strict=True))
    if name.startswith("op9"):
        texts = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()}
        assert all(texts[i] == d for i, d in zip(rows["doc_id"], rows["decoded_sha256"], strict=True))
    if name.startswith("op7"):
        untouched = rows[rows["n_removed"] == 0].set_index("doc_id")["kept_sha256"]
        texts = {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect()}
        assert ((rows["n_removed"] == 0) == (rows["n_spans"] == 0)).all() and all(texts[i] == d for i, d in untouched.items())


def test_tokens_of_lines_and_leaks(spark, sf_dir):
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    items = {r["item_id"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id").collect()}
    assert {r["doc_id"] for r in queries.QUERIES["op3_token_attribution"](spark, sf_dir).collect()} <= ids
    leaks = queries.QUERIES["op4_bm25_decontaminate"](spark, sf_dir).collect()
    assert {r["doc_id"] for r in leaks} <= ids and {r["item_id"] for r in leaks} <= items
