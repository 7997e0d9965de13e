"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bm25_decontaminate, bpe_tree, chunk_recipes, credential_grammar, feistel_shards, quality_trees, repeat_intervals, russian_negatives, sketch_search, subword_toxicity, token_attribution, tool_calls, vantage_simhash
from millrace.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_credential_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credential_grammar.scan(table(spark, sf_dir, "documents"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations")
    return tool_calls.link_tool_calls(tool_calls.calls_of(chats), tool_calls.results_of(chats), tool_calls.tools_of(chats))


def op3_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sections are lines; a token over a line end goes to the line with most of it, or to the last one.
    return token_attribution.section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, rules=("largest", "last"))


def op4_bm25_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_decontaminate.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel_shards.shard_rows(table(spark, sf_dir, "documents"), shards=16)


def op6_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_intervals.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return subword_toxicity.toxicity(docs, subword_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_recipes.exact_groups(table(spark, sf_dir, "documents"))


def op11_russian_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return russian_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, relabel)


def op12_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_trees.quality(docs, quality_trees.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_credential_grammar, op2_tool_calls, op3_token_attribution, op4_bm25_decontaminate, op5_feistel_shards, op6_vantage_simhash, op7_repeat_intervals, op8_subword_toxicity, op9_bpe_tree, op10_chunk_recipes, op11_russian_negatives, op12_sketch_search, op13_quality_trees)}

ORACLE_SQL: dict[str, str] = {
    "op2_tool_calls": """
        WITH RECURSIVE asked AS (
            SELECT conv_id, turn, coalesce(text, '') AS body, length(coalesce(text, '')) AS size, turn % 2 AS odd, (turn + turn % 2) // 2 - 1 AS number
            FROM conversations WHERE role = 'assistant'
        ), calls AS (
            SELECT conv_id, 'call_' || conv_id || '_' || turn AS call_id,
                CASE WHEN number > 0 THEN 'call_' || conv_id || '_' || (2 * ((number - 1) // 2) + 2 - odd) END AS parent_id,
                CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'summarise' ELSE 'translate' END AS name,
                CASE turn % 3
                    WHEN 0 THEN '{"limit":' || (size % 10) || ',"query":' || to_json(body) || '}'
                    WHEN 1 THEN '{"text":' || to_json(body) || ',"words":' || CASE WHEN size % 7 = 0 THEN '"' || size || '"' ELSE size::VARCHAR END || '}'
                    ELSE CASE WHEN size % 5 = 0 THEN '{"into":"en","text":' || to_json(body) || '}' ELSE '{"text":' || to_json(body) || ',"to":"en"}' END
                END AS arguments,
                CASE WHEN turn % 3 = 1 AND size % 7 = 0 THEN 'type:words' WHEN turn % 3 = 2 AND size % 5 = 0 THEN 'missing:to,unknown:into' ELSE '' END AS errors
            FROM asked
        ), forest AS (
            SELECT call_id, 0::BIGINT AS level FROM calls WHERE parent_id IS NULL OR parent_id NOT IN (SELECT call_id FROM calls)
            UNION ALL
            SELECT c.call_id, f.level + 1 FROM calls c JOIN forest f ON c.parent_id = f.call_id
        ), results AS (
            SELECT conv_id, 'call_' || conv_id || '_' || (turn - 1) AS call_id, text AS content, true AS answered FROM conversations WHERE role = 'user' AND turn > 0
        )
        SELECT conv_id, call_id,
            CASE WHEN name IS NULL THEN 'orphan' WHEN answered IS NULL THEN 'pending' ELSE 'linked' END AS status,
            level, CASE WHEN name IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, name IS NULL ORDER BY level, call_id) - 1 END AS position,
            name, CASE WHEN name IS NOT NULL THEN errors = '' END AS valid, errors, CASE WHEN name IS NOT NULL THEN 0 END AS n_repeats,
            '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS message
        FROM calls FULL JOIN results USING (conv_id, call_id) LEFT JOIN forest USING (call_id)""",
    "op10_chunk_recipes": """
        WITH normal AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
        ), groups AS (
            SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY body
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256
        FROM normal JOIN groups USING (body)""",
    "op11_russian_negatives": """
        WITH kept AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
            FROM kept a JOIN kept b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
    "op12_sketch_search": """
        WITH terms AS (
            SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents
        ), sized AS (
            SELECT doc_id, row_no, words, len(words) AS n FROM terms WHERE len(words) > 0
        ), whole AS (
            SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM sized
        ), tf AS (
            SELECT row_no, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT row_no, doc_id, n, unnest(words) AS term FROM sized) GROUP BY row_no, term
        ), asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, docs
        ), scores AS (
            SELECT item_id, doc_id, row_no, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN tf USING (term), whole GROUP BY item_id, doc_id, row_no
        ), best AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scores WHERE score > 0
        )
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 50""",
}
