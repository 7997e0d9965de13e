"""Exact dedup by content-defined chunk recipes.

A normalised text is cut where its content says so, after MIN_CHARS characters and at
MAX_CHARS at the latest: at the first line or sentence end in any script; where there is
none so far, after the first blank or sign; and in one long word after the first of some
letters. Each distinct chunk crosses the network once, to verify that its 64-bit
identifier stands for one chunk only; from then on a text is its recipe, the ordered list
of identifiers, about one hundredth of its size. Equal recipes are equal texts.

All of it is DataFrame operations. Chunks are made distinct before they are shuffled,
recipes are kept once they are made, and groups of recipes are counted before they are
shuffled, so a group that holds a third of all rows is a few rows to each task. The join
that hands the group's result back to its rows deals the rows of hot groups over many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, durable, each_copy, joined_back, texts, without

MIN_CHARS = 512
MAX_CHARS = 4096


#: Where a text may be cut, from the best places on: ends of lines and sentences, blanks and signs, some letters of each
#: script (of ASCII those whose code is 5 modulo 8, of others the first 8 of each 256 code points).
CUTS = (
    r"\n|[.!?](?=\s)|[\u3002\uFF01\uFF1F\u0964\u06D4]",
    r"[\s\p{P}]",
    "[" + "".join(re.escape(chr(c)) for c in range(0x2D, 0x7F, 8)) + "".join(f"\\u{high:02X}00-\\u{high:02X}07" for high in range(1, 256) if not 0xD8 <= high <= 0xDF) + "]",
)


def chunks(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """The chunks of a text in order; joined, they are the text again."""
    cut = "(?s)" + "|".join(r".{%d,%d}?(?:%s)" % (least - 1, most - 1, end) for end in CUTS) + r"|.{1,%d}" % most
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def colliding(pieces: DataFrame) -> DataFrame:
    """(h, chunk, variant) of identifiers h that stand for more than one chunk; as a rule none.

    pieces: (h, chunk).
    """
    distinct = pieces.distinct()
    shared = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return distinct.join(shared, "h", "left_semi").withColumn("variant", F.sha2("chunk", 256))


def recipes(docs: DataFrame, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, recipe, text_sha256) of each row; recipes are equal just where normalised texts are.

    identify: the identifier of a chunk, a long. Collisions are looked for over all
    chunks first. If there are any, every identifier is made exact by the digest of
    its chunk where it is shared: identifiers are then (h, variant).
    """
    docs = docs.select("doc_id", ascii_lower(F.col("text")).alias("text"))
    cut = docs.select("doc_id", "text", chunks(F.col("text")).alias("cut"))
    shared = colliding(cut.select(F.explode("cut").alias("chunk")).select(identify(F.col("chunk")).alias("h"), "chunk"))
    digest = F.sha2(F.col("text"), 256).alias("text_sha256")
    if shared.isEmpty():
        return cut.select("doc_id", F.transform("cut", lambda c: identify(c)).alias("recipe"), digest)
    at = cut.select("doc_id", digest, F.posexplode_outer("cut").alias("pos", "chunk")).withColumn("h", identify(F.col("chunk")))
    exact = at.join(shared, ["h", "chunk"], "left").select("doc_id", "text_sha256", F.struct("pos", "h", "variant").alias("id"))
    # A repeated row repeats its identifiers, so they are taken as a set.
    listed = exact.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set("id")).alias("recipe"))
    rows = docs.select("doc_id", digest).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"))
    same = listed["doc_id"].eqNullSafe(rows["doc_id"]) & (listed["text_sha256"] == rows["text_sha256"])
    listed = rows.join(listed, same, "left").select(rows["doc_id"], F.filter("recipe", lambda x: x["h"].isNotNull()).alias("recipe"), rows["text_sha256"], "copies")
    return each_copy(listed, "copies").drop("copies", "copy")


def exact_groups(docs: DataFrame, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the largest
    doc_id stays. Null text is empty; empty texts are equal to each other. A row with a
    null doc_id counts in its group but stays only if no doc_id is known there. Rows
    that repeat a doc_id with the same text are one document and are all marked kept
    (or not); group_size counts them all. Other columns are ignored.
    """
    row = durable(recipes(texts(docs), identify))
    group = row.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return joined_back(row, group, ["recipe"], "group_size", row.count()).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without those that exact_groups does not mark kept.

    Only doc_ids and digests are joined to the rows. A row goes for its own text: other
    texts under its doc_id, or under a null one, stay.
    """
    lost = exact_groups(docs).filter(~F.col("kept"))
    return without(docs, lost, F.sha2(ascii_lower(F.coalesce(docs["text"].cast("string"), F.lit(""))), 256))
