"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Row numbers come from counts, not from one sorted task: rows fall into a fixed number
of buckets by a hash, bucket sizes are summed up, and each row is numbered within its
bucket. The permutation is a Feistel network over pairs (left, right) with left below
a and right below b, where a = ceil(sqrt(n)) and b = ceil(n / a). At most a - 1 of its
values are n or more; such a value is permuted again (cycle walking) until it is below
n. The place of row i is then p(i): shard p mod S, slot p div S, so shards differ by one
row at most and slots have no gaps. Both directions are computable for any one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import each_copy, texts

BUCKETS = 16384
ROUNDS = 6
#: A walk of more steps has a chance below (1 / sqrt(n)) ** WALK; it stops the job, never a wrong place.
WALK = 64


def feistel(x: Column, a: Column, b: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """A permutation of 0 to a * b - 1 as a column."""
    state = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
    steps = F.sequence(F.lit(0), F.lit(rounds - 1))

    def step(s: Column, k: Column) -> Column:
        noise = F.xxhash64(F.lit(seed).cast("long"), k.cast("long"), F.when(k % 2 == 0, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(k % 2 == 0, F.pmod(s["l"] + F.pmod(noise, a), a)).otherwise(s["l"]).alias("l"),
            F.when(k % 2 == 1, F.pmod(s["r"] + F.pmod(noise, b), b)).otherwise(s["r"]).alias("r"),
        )

    return F.aggregate(steps, state, step, lambda s: s["l"] + a * s["r"])


def inverse_feistel(y: Column, a: Column, b: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """The x with feistel(x) = y."""
    state = F.struct((y % a).alias("l"), F.floor(y / a).cast("long").alias("r"))
    steps = F.sequence(F.lit(rounds - 1), F.lit(0))

    def step(s: Column, k: Column) -> Column:
        noise = F.xxhash64(F.lit(seed).cast("long"), k.cast("long"), F.when(k % 2 == 0, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(k % 2 == 0, F.pmod(s["l"] - F.pmod(noise, a), a)).otherwise(s["l"]).alias("l"),
            F.when(k % 2 == 1, F.pmod(s["r"] - F.pmod(noise, b), b)).otherwise(s["r"]).alias("r"),
        )

    return F.aggregate(steps, state, step, lambda s: s["l"] + a * s["r"])


def walked(x: Column, n: Column, a: Column, b: Column, seed: int, one=feistel) -> Column:
    """A permutation of 0 to n - 1: permute, and again while the value is n or more."""
    place = one(x, a, b, seed)
    place = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), place, lambda v, _: F.when(v >= n, one(v, a, b, seed)).otherwise(v))
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("the cycle walk is too long; take another seed")).cast("long"))


def numbered(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """rows (doc_id, size, text_crc32) with global row numbers: row_no, and n, the number of rows.

    Rows that are alike in all three are counted before they move, so that a row repeated
    any number of times is one row to the window, and numbered by blocks of copies.
    """
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)))
    sizes = alike.groupBy("bucket").agg(F.sum("copies").alias("in_bucket"))
    # As many rows as there are buckets, whatever the input.
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select("bucket", (F.sum("in_bucket").over(upto) - F.col("in_bucket")).alias("offset"), F.sum("in_bucket").over(Window.partitionBy()).alias("n"))
    before = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = alike.withColumn("first", F.sum("copies").over(before) - F.col("copies")).join(F.broadcast(offsets), "bucket")
    return each_copy(first, "copies").select("doc_id", "size", "text_crc32", "n", (F.col("offset") + F.col("first") + F.col("copy")).alias("row_no"))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20_240_101) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no: one row for each row of docs.

    size: UTF-8 bytes of the text plus 1, null text being none. law is `rows`: counts
    differ by one at most, so with another number of shards nearly all rows move and
    grown_shard is null. The result depends on the rows and the seed only, not on files
    or partitions. Null doc_ids are numbered first; repeated rows get places of their
    own; an empty table gives no rows; other columns are ignored.
    """
    text = texts(docs)
    rows = numbered(text.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32")))
    a = F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long")
    placed = rows.withColumn("a", a).withColumn("b", F.ceil(F.col("n") / F.col("a")).cast("long"))
    placed = placed.withColumn("place", walked(F.col("row_no"), F.col("n"), F.col("a"), F.col("b"), seed))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no")
