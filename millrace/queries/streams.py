"""Queries that read files and run streams: events are written as log files in a folder that all machines share, in the order of their ids."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dimensions
from millrace.plans.task import LogTask
from millrace.queries.logs import _PATTERNS, ALL, BY_LEVEL, DAY, _task, _value
from millrace.queries.metrics import DAILY, daily
from millrace.queries.scalars import USER
from millrace.queries.tables import LINES, event_lines, table
from millrace.sources import growing, logs, paths
from millrace.streaming import series, sinks, tasks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Windows that the watermark, a second behind the last event, has passed.
CLOSED = "epoch_ms(date_trunc('day', ts)) + 86400000 <= epoch_ms((SELECT max(ts) FROM events)) - 1000"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/streams-{uuid.uuid4().hex}"


def event_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the events as log files, whose names and lines are in order."""
    where = folder(spark)
    lines = event_lines(spark, sf_dir)
    lines.repartitionByRange(8, "ord").sortWithinPartitions("ord").select("line").write.text(f"{where}/logs")
    return f"{where}/logs"


def ran(stream: DataFrame) -> DataFrame:
    """All rows that a stream over what is there now emits, through the committed table of a sink."""
    spark = stream.sparkSession
    where = folder(spark)
    sinks.start(stream, sinks.fan_out([sinks.detail_table(f"{where}/out")]), f"{where}/state").awaitTermination()
    return sinks.read_table(spark, f"{where}/out")


@query(f"WITH {LINES} SELECT count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines")
def S2_read_glob(spark, sf_dir):
    lines = logs.read_log_lines(spark, [f"{event_files(spark, sf_dir)}/part-*.txt"])
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(f"WITH {LINES} SELECT event_type AS kind, count(*) AS lines, min(line) AS least FROM lines GROUP BY event_type")
def S3_S4_read_matching(spark, sf_dir):
    where = folder(spark)
    lines = event_lines(spark, sf_dir)
    lines.withColumn("kind", F.lower(F.regexp_extract("line", r"^\S+ \S+ (\w+)", 1))).select("line", "kind").write.partitionBy("kind").text(where)
    found = logs.read_matching(spark, where, "^.*/kind=(?P<kind>[^/]+)/part-[^/]+[.]txt$")
    return found.groupBy(F.col("path_tags")["kind"].alias("kind")).agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("least"))


@query(f"""WITH {LINES} SELECT strftime(ts, '%Y%m%d') AS day, count(*) AS lines FROM lines WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06' GROUP BY ALL""")
def S5_read_dated(spark, sf_dir):
    # A folder for each day, of which those of a backfill's hours are read.
    where = folder(spark)
    lines = event_lines(spark, sf_dir).withColumn("day", F.translate(F.substring("line", 1, 10), "-", ""))
    lines.select("line", "day").write.partitionBy("day").text(where)
    dated = paths.dated_range(f"{where}/day={{time:yyyyMMdd}}/*.txt", datetime(2024, 1, 3), datetime(2024, 1, 5, 23))
    found = logs.read_log_lines(spark, dated)
    return found.groupBy(F.regexp_extract("path", r"day=(\d+)", 1).alias("day")).agg(F.count(F.lit(1)).alias("lines"))


@query(f"WITH {LINES} SELECT count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM lines")
def S1_growing_files(spark, sf_dir):
    # The shared folder is mounted, as log volumes are; splits are small, so that lines cross them.
    where = event_files(spark, sf_dir).removeprefix("file:")
    lines = ran(growing.stream_growing_lines(spark, f"{where}/part-*.txt", split_bytes=64 << 10).select("path", "ord", "line"))
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))


@query(f"""WITH {LINES} SELECT {DAY} AS window_start, upper(event_type) AS level, count(*) AS n, round(CAST(sum(cost) AS DOUBLE), 6) AS total, round(CAST(sum(cost) AS DOUBLE) / count(*), 6) AS mean,
    round(CAST(min(cost) AS DOUBLE), 6) AS least, round(CAST(max(cost) AS DOUBLE), 6) AS most FROM lines WHERE {CLOSED} GROUP BY ALL""")
def T1_stream_windows(spark, sf_dir):
    stream = tasks.run_stream(_task(ALL, BY_LEVEL), logs.stream_log_lines(spark, event_files(spark, sf_dir)))
    return ran(_shown(stream))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("total", "mean", "least", "most") if c in df.columns} | {"window_start": F.unix_millis("window_start")})


@query(f"""WITH {LINES}, seen AS (SELECT {DAY} AS window_start, CAST(user_id AS VARCHAR) AS who, min(event_id) AS seen, count(*) AS n, round(CAST(sum(cost) AS DOUBLE), 6) AS total FROM lines WHERE {CLOSED} GROUP BY ALL)
    SELECT window_start, who, n, total FROM seen QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY seen) <= 5""")
def T1_A13_stream_key_cap(spark, sf_dir):
    task = _task([_value("n", "count"), _value("total", "sum")], [{"name": "who", "elect": USER}], group={"maxKeySize": 5})
    return ran(_shown(tasks.run_stream(task, logs.stream_log_lines(spark, event_files(spark, sf_dir), ordered=True))))


@query(f"""WITH {LINES}, ranked AS (SELECT {DAY} AS window_start, upper(event_type) AS level, event_id, line, cost, row_number() OVER (PARTITION BY date_trunc('day', ts), event_type, cost > 20 ORDER BY event_id) AS r FROM lines WHERE {CLOSED})
    SELECT window_start, level, count(*) AS value, '{{"maxCount":2,"samples":[' || string_agg('{{"hostname":"","logs":["' || substr(line, 1, 40) || '"]}}', ',' ORDER BY event_id) FILTER (cost > 20 AND r <= 2) || ']}}' AS log_samples FROM ranked GROUP BY ALL""")
def T1_A14_stream_samples(spark, sf_dir):
    task = _task([_value("n", "count")], BY_LEVEL)
    task.conf["select"]["logSamples"] = {"enabled": True, "maxCount": 2, "maxLength": 40, "where": {"numberOp": {"elect": _value("x", "sum")["elect"], "gt": 20}}}
    return ran(_shown(tasks.run_stream(task, logs.stream_log_lines(spark, event_files(spark, sf_dir), ordered=True))))


@query(f"""WITH {LINES}, named AS (SELECT CAST(epoch_ms(ts) // 864000000 * 864000000 AS BIGINT) AS window_start, CASE WHEN event_type = 'error' THEN 'errors' WHEN cost > 50 THEN 'high' END AS "eventName" FROM lines)
    SELECT window_start, "eventName", count(*) AS value FROM named WHERE "eventName" IS NOT NULL AND window_start + 864000000 <= (SELECT epoch_ms(max(ts)) - 1000 FROM events) GROUP BY ALL""")
def T1_K1_K7_stream_analysis(spark, sf_dir):
    task = LogTask({"select": {"values": [{"agg": "loganalysis"}]}, "from": {"log": {"time": {"type": "auto"}}}, "groupBy": {"logAnalysis": {"patterns": _PATTERNS, "maxUnknownPatterns": 4}}, "window": {"interval": "10d"}})
    found = ran(tasks.run_stream(task, logs.stream_log_lines(spark, event_files(spark, sf_dir), ordered=True)))
    # Clusters have no SQL; tests hold them against the batch analysis.
    return found.filter("eventName <> '__analysis'").select(F.unix_millis("window_start").alias("window_start"), "eventName", "value")


@query(f"WITH {LINES} SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, round(CAST(sum(cost) AS DOUBLE), 4) AS total FROM lines WHERE cost > 10 GROUP BY ALL")
def O1_O4_metric_and_detail_tables(spark, sf_dir):
    task = _task([_value("cost", "sum")], BY_LEVEL, {"numberOp": {"elect": _value("x", "sum")["elect"], "gt": 10}}, group={"details": {"enabled": True}})
    rows = tasks.run_stream(task, logs.stream_log_lines(spark, event_files(spark, sf_dir)))
    metrics = rows.select(F.lit("cost").alias("name"), F.create_map(F.lit("level"), "level").alias("tags"), "ts", F.col("cost").alias("value"))
    where = folder(spark)
    both = sinks.fan_out([sinks.metric_table(f"{where}/metrics"), sinks.detail_table(f"{where}/details")])

    def twice(df: DataFrame, batch: int) -> None:
        # A batch that comes again leaves what one has left.
        both(df, batch)
        both(df, batch)

    sinks.start(metrics, twice, f"{where}/state").awaitTermination()
    stored = sinks.read_table(spark, f"{where}/metrics").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return stored.join(sinks.read_table(spark, f"{where}/details").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n")), ["date", "n"]).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {DAILY} SELECT now.name, now.team, CAST(epoch_ms(now.ts) AS BIGINT) AS ts, greatest(now.value - old.value, 0) AS value FROM daily AS now JOIN daily AS old ON now.name = old.name AND now.team = old.team AND old.ts = now.ts - INTERVAL 1 DAY")
def T1_M3_stream_delta(spark, sf_dir):
    where = folder(spark)
    samples = daily(spark, sf_dir)
    samples.write.parquet(where)
    stream = spark.readStream.schema(samples.schema).parquet(where)
    return ran(series.stream_delta(stream, 86_400_000).select("name", F.col("tags")["team"].alias("team"), F.unix_millis("ts").alias("ts"), "value"))


@query("""WITH last AS (SELECT CAST(user_id AS VARCHAR) AS name, max_by(event_id, (ts, event_id)) AS seq FROM events GROUP BY user_id)
    SELECT name, seq, value FROM last JOIN events ON event_id = seq WHERE event_type NOT IN ('error', 'view')""")
def N6_stream_snapshot(spark, sf_dir):
    where = folder(spark)
    e = table(spark, sf_dir, "events")
    events = e.select(F.col("user_id").cast("string").alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("event"), F.when(F.col("event_type") == "view", "Failed").otherwise("Running").alias("phase"), "value")
    events.repartition(4, "seq").write.parquet(f"{where}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
    sinks.start(stream, sinks.snapshot_table(f"{where}/out", ["name"], ["ts", "seq"], 8), f"{where}/state").awaitTermination()
    return sinks.read_snapshot(spark, f"{where}/out", dimensions.gone()).select("name", "seq", "value")
