"""Views of the driver's tables that several queries read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over as many tasks as there are cores, where its files are fewer splits than that."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines, with the columns of a parsed record."""
    e = spread(table(spark, sf_dir, "events"), "event_id")
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    cost = F.col("value").cast("decimal(18,2)").cast("string")
    line = F.concat(ts, F.lit(" "), F.upper("event_type"), F.lit(" [user-"), F.col("user_id"), F.lit("] cost="), cost, F.lit(" props="), F.col("props"))
    none = F.create_map().cast("map<string,string>")
    # A generator makes the text once; a projection would be merged into each later use.
    made = e.select(F.col("event_id").alias("ord"), F.explode(F.array(line)).alias("line"))
    return made.select(F.lit("events").alias("path"), F.lit(0).alias("block"), "ord", "line", F.array("line").alias("lines"), none.alias("log_tags"), none.alias("path_tags"))


LINES = """lines AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' ' || upper(event_type) || ' [user-' || user_id || '] cost=' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' props=' || props AS line, ts, event_type, user_id, CAST(value AS DECIMAL(18,2)) AS cost, props FROM events)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: a document is a file, blocks are of 64 lines."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line"))
    none = F.create_map().cast("map<string,string>")
    return d.select("path", F.floor(F.col("at") / 64).alias("block"), F.col("at").cast("long").alias("ord"), "line", none.alias("log_tags"), none.alias("path_tags"))


DOCUMENT_LINES = """doc_lines AS (SELECT CAST(doc_id AS VARCHAR) AS path, i - 1 AS ord, parts[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i))"""


def millis(ts: Column | str) -> Column:
    return F.unix_millis(ts)
