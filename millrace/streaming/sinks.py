"""Sinks of metric and detail rows.

A table is a folder of contents and commit records. What a micro-batch writes is a folder
of its own, and a record under the batch's number, moved into place in one step, says
which folder counts. A batch that runs again, with other rows or none, writes another
folder and replaces the record, so readers see what it wrote before or what it wrote now
and never a mixture.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

Writer = Callable[[DataFrame, int], None]
COMMITS = "_commits"


class _Files:
    """Files of a table by Hadoop's file system, wherever it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop, self.gateway = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._gateway
        conf = spark._jsc.hadoopConfiguration()
        self.root = self.hadoop.Path(path)
        self.fs = self.root.getFileSystem(conf)
        self.context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), conf)

    def at(self, *parts: str):
        return self.hadoop.Path(self.root, "/".join(parts))

    def replace(self, name: str, text: str) -> None:
        """Writes a commit record in one step."""
        fresh = self.at(COMMITS, f".{name}.{uuid.uuid4().hex}")
        out = self.fs.create(fresh, True)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.gateway.new_array(self.hadoop.Options.Rename, 1)
        options[0] = self.hadoop.Options.Rename.OVERWRITE
        self.context.rename(self.fs.makeQualified(fresh), self.fs.makeQualified(self.at(COMMITS, name)), options)

    def records(self) -> dict[str, dict]:
        """The commit records by name."""
        if not self.fs.exists(self.at(COMMITS)):
            return {}
        names = [f.getPath().getName() for f in self.fs.listStatus(self.at(COMMITS))]
        return {n: json.loads(self.read(n)) for n in sorted(names) if not n.startswith(".")}

    def read(self, name: str) -> str:
        file = self.fs.open(self.at(COMMITS, name))
        try:
            return bytes(file.readAllBytes()).decode()
        finally:
            file.close()


def replaced_table(path: str, partitions: Sequence[str] = (), task: str = "all") -> Writer:
    """Writes Parquet by the given columns; what a batch of a task wrote is replaced whole when it runs again."""

    def write(df: DataFrame, batch: int) -> None:
        files = _Files(df.sparkSession, path)
        name, folder = f"{task}-{batch:012d}", f"content/commit={task}-{batch:012d}-{uuid.uuid4().hex}"
        df.write.partitionBy(*partitions).parquet(f"{path}/{folder}")
        old = files.records().get(name)
        files.replace(name, json.dumps({"folder": folder, "schema": df.schema.json()}))
        if old:
            files.fs.delete(files.at(old["folder"]), True)

    return write


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches of a table."""
    records = list(_Files(spark, path).records().values())
    if not records:
        raise FileNotFoundError(f"no batch of {path} was committed")
    # One read of all folders, with the columns of the last batch; one without rows has no files to tell them.
    schema = T.StructType.fromJson(json.loads(records[-1]["schema"]))
    read = spark.read.schema(T.StructType([*schema.fields, T.StructField("commit", T.StringType())])).option("basePath", f"{path}/content")
    return read.parquet(*[f"{path}/{r['folder']}" for r in records]).select(*schema.names)


def metric_table(path: str, task: str = "all") -> Writer:
    """Writes (name, tags, ts, value) as a replaced table by date."""
    write = replaced_table(path, ["date"], task)
    return lambda df, batch: write(df.withColumn("date", F.to_date("ts")), batch)


def detail_table(path: str, task: str = "all") -> Writer:
    """Writes detail rows as a replaced table."""
    return replaced_table(path, (), task)


def console(rows: int = 20) -> Writer:
    return lambda df, batch: df.show(rows, truncate=False)


def fan_out(writers: list[Writer]) -> Writer:
    """The same rows to every writer, computed once."""

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            for one in writers:
                one(df, batch)
        finally:
            df.unpersist()

    return write


def start(df: DataFrame, writer: Writer, checkpoint: str, mode: str = "append", **trigger) -> StreamingQuery:
    """Runs a stream into a writer."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(writer)
    return query.trigger(**(trigger or {"availableNow": True})).start()


def snapshot_table(path: str, key: Sequence[str], order: Sequence[str], buckets: int = 64) -> Writer:
    """Keeps the last event of each key, by order, over all batches; read it with read_snapshot.

    Rows are dealt over buckets by their key. A batch rewrites the buckets that it has
    events for, and one commit record names the folder of each bucket, so readers see all
    of a batch or none. Events of deletion stay as tombstones: a repeated batch or an event
    that comes late changes nothing. The folders that a commit replaces go with the next one.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        files = _Files(spark, path)
        now = files.records().get("snapshot", {"buckets": {}, "replaced": []})
        events = df.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = sorted(str(r["bucket"]) for r in events.select("bucket").distinct().collect())
            if not touched:
                return
            old = [now["buckets"][b] for b in touched if b in now["buckets"]]
            rows = events.unionByName(_buckets(spark, path, old, events.schema)) if old else events
            newest = rows.groupBy("bucket", *key).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row")).select("bucket", "row.*")
            folder = f"content/commit={batch:012d}-{uuid.uuid4().hex}"
            newest.write.partitionBy("bucket").parquet(f"{path}/{folder}")
        finally:
            events.unpersist()
        now["buckets"] |= {b: f"{folder}/bucket={b}" for b in touched}
        files.replace("snapshot", json.dumps({"buckets": now["buckets"], "replaced": old, "schema": df.schema.json()}))
        for part in now["replaced"]:
            files.fs.delete(files.at(part), True)

    return write


def _buckets(spark: SparkSession, path: str, parts: list[str], schema: T.StructType) -> DataFrame:
    whole = T.StructType([*[f for f in schema.fields if f.name != "bucket"], T.StructField("commit", T.StringType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(whole).option("basePath", f"{path}/content").parquet(*[f"{path}/{p}" for p in parts]).drop("commit")


def read_snapshot(spark: SparkSession, path: str, gone=None) -> DataFrame:
    """The last event of each key, without those for which gone, a condition, holds."""
    record = _Files(spark, path).records().get("snapshot")
    if record is None:
        raise FileNotFoundError(f"no batch of {path} was committed")
    rows = _buckets(spark, path, sorted(record["buckets"].values()), T.StructType.fromJson(json.loads(record["schema"]))).drop("bucket")
    return rows if gone is None else rows.filter(~F.coalesce(gone, F.lit(False)))
