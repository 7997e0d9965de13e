"""The pipeline stage by stage."""

from array import array

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import bm25_decontaminate, subword_toxicity
from millrace.llm.bpe_tree import read_ranks


def test_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, sf_dir).persist()
        assert rows.columns == columns, name
        now = {r["doc_id"] for r in rows.select("doc_id").collect()}
        assert now < kept, name
        docs, kept = rows, now
    model = subword_toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert subword_toxicity.toxicity(docs, model).filter("predicted = 1").count() == 0
    assert bm25_decontaminate.leaked_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    result = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(result) == kept
    encoding = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for row in docs.collect():
        ids = encoding.encode_ordinary(row["text"] or "")
        assert bytes(result[row["doc_id"]]["ids"]) == array("I", ids).tobytes()
        assert bytes(result[row["doc_id"]]["decoded"]).decode() == (row["text"] or "")


def test_stages_on_odd_rows(spark, sf_dir, odd, empty):
    import corpus_pipeline

    want = {
        "toxicity": [(r["doc_id"], r["text"]) for r in odd.collect()],
        "exact dedup": [(1, "another"), (2, "SAME text here"), (3, None), (3, None)],
        "simhash near-dedup": [(1, "same text here"), (1, "same text here"), (1, "another"), (3, None), (3, None)],
        "benchmark decontamination": [(r["doc_id"], r["text"]) for r in odd.collect()],
    }
    clash = odd.withColumn("row", F.lit("clash")).withColumn("own_id", F.lit("clash")).withColumn("salt", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, clash, sf_dir)
        assert rows.columns == clash.columns, name
        assert sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=repr) == sorted(want[name], key=repr), name
        assert stage(spark, empty, sf_dir).count() == 0
    coded = corpus_pipeline.STAGES[-1][1](spark, odd, sf_dir).collect()
    assert sorted(((r["doc_id"], bytes(r["decoded"])) for r in coded), key=repr) == sorted(((r["doc_id"], (r["text"] or "").encode()) for r in odd.collect()), key=repr)
