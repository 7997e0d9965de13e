"""Corpus cleaning pipeline: five stages from documents to encoded documents.

Each stage works on all rows that its predecessor kept and returns the columns of
documents; the last returns the token ids of what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bm25_decontaminate, bpe_tree, chunk_recipes, subword_toxicity, vantage_simhash
from millrace.llm.common import durable, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model fitted on labels does not reject. A null or empty text is judged as one without words; rows with null or repeated doc_ids each by their own text."""
    return subword_toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id; null counts as empty. Rows of a null doc_id stay only if their text has no known one; repeats of the row that stays, stay."""
    return chunk_recipes.drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the row with the smallest doc_id, null only where none is known; texts without words are near each other. Repeats of the row that stays, stay."""
    return vantage_simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of benchmark. Null and empty texts hold none; each row is judged by its own text."""
    return bm25_decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded, one row for each row; a null or empty text has no ids, a null doc_id stays null."""
    return bpe_tree.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("byte-level bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what lies between two stages is kept in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs


#: The stages hash, score and train; SQL cannot express them.
ORACLE_SQL = None
