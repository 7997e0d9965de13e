"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into numpy arrays at once.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame) -> DataFrame:
    """(doc_id, text) of any table that has them: other columns go, null text is empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(df["text"].cast("string"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other letter stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(docs: DataFrame, lost: DataFrame, digest: Column) -> DataFrame:
    """The rows of docs, all columns, that are not in lost (doc_id, text_sha256).

    digest: the text_sha256 of a row of docs. A null doc_id in lost stands for rows with a null doc_id and that text only.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), digest.alias("own_text"))
    lost = lost.select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_text")).distinct()
    return rows.join(lost, F.col("own_id").eqNullSafe(F.col("lost_id")) & (F.col("own_text") == F.col("lost_text")), "left_anti").select("row.*")


#: A group is hot with more than one in HOT_SHARE of the rows, so there are fewer hot groups than that; its rows are dealt over SALTS tasks.
HOT_SHARE, SALTS = 2048, 64


def joined_back(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str, total: int) -> DataFrame:
    """rows with the columns of groups by keys, without one task for the rows of a hot group.

    groups: one row for each key, column size counting its rows among the `total` ones of
    rows. Only hashes of hot keys, below HOT_SHARE of them, are broadcast; their groups are
    repeated for each salt, and their rows are salted by partition. Keys are not null.
    """
    hash_of = F.xxhash64(*keys)
    hot = groups.filter(F.col(size) * HOT_SHARE > total).select(hash_of.alias("hot_hash")).distinct()
    salted = rows.withColumn("row_part", F.spark_partition_id()).join(F.broadcast(hot), hash_of == F.col("hot_hash"), "left")
    salted = salted.withColumn("salt", F.when(F.col("hot_hash").isNull(), 0).otherwise(F.pmod(F.col("row_part"), F.lit(SALTS)))).drop("row_part", "hot_hash")
    spread = groups.join(F.broadcast(hot), hash_of == F.col("hot_hash"), "left")
    salts = F.when(F.col("hot_hash").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = spread.withColumn("salt", F.explode(salts)).drop("hot_hash")
    return salted.join(spread, [*keys, "salt"]).drop("salt")


def each_copy(rows: DataFrame, copies: str, block: int = 4096) -> DataFrame:
    """Each row of rows as often as its column `copies` says, with copy, its number from 0.

    Numbers are made by blocks and blocks are dealt over tasks, so no task makes all copies of a row.
    """
    starts = rows.withColumn("copy_block", F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / block).cast("long"))))
    last = F.least(F.col(copies), (F.col("copy_block") + 1) * block) - 1
    return starts.hint("rebalance").withColumn("copy", F.explode(F.sequence(F.col("copy_block") * block, last))).drop("copy_block")


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept where every executor reads them.

    They go to spark.checkpoint.dir, a folder that all machines share. Where it is not
    set, a local session takes a folder in its warehouse, a cluster is told to set it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(where or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return df.checkpoint()


def blocks(lengths: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows that hold about `most` bytes each, one row at least."""
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)
