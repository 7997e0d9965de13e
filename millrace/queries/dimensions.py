"""Queries of dimension operators; customers are pods, nations are nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import dimensions as d
from millrace.queries.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, even = table(spark, sf_dir, "customer"), F.col("c_custkey") % 2 == 0
    labels = F.create_map(F.lit("app"), F.when(even, F.col("c_mktsegment")).otherwise(""), F.lit("app.kubernetes.io/name"), F.when(F.col("c_custkey") % 3 == 0, F.lit("third")), F.lit("hostname"), F.when(F.col("c_custkey") % 5 == 0, F.lit("given")))
    return c.select(F.concat(F.lit("ns"), F.col("c_nationkey").cast("string")).alias("namespace"), F.col("c_name").alias("name"), F.concat(F.lit("10.0.0."), F.col("c_custkey").cast("string")).alias("ip"), labels.alias("labels"), F.when(even, F.lit("")).otherwise("spec").alias("spec_hostname"), "c_custkey")


@query("""SELECT 'ns' || c_nationkey AS namespace, c_name AS pod, '10.0.0.' || c_custkey AS ip, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'third' END AS app,
    CASE WHEN c_custkey % 5 = 0 THEN 'given' WHEN c_custkey % 2 = 1 THEN 'spec' ELSE c_name END AS hostname FROM customer""")
def N1_N2_pod_tags(spark, sf_dir):
    return d.pod_tags(pods(spark, sf_dir), ["app", "app.kubernetes.io/name"])


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'proxy' WHEN 1 THEN 'main' WHEN 2 THEN 'main' ELSE 'proxy' END AS main FROM customer")
def N3_main_container(spark, sf_dir):
    env = F.array(F.struct(F.lit("SIDECAR").alias("name"), F.lit("1").alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    box = lambda name, e: F.struct(F.lit(name).alias("name"), e.alias("env"))
    kind = F.col("c_custkey") % 4
    containers = F.when(kind == 0, F.array(box("proxy", none))).when(kind == 1, F.array(box("proxy", none), box("main", none))).when(kind == 2, F.array(box("helper", env), box("main", none))).otherwise(F.array(box("proxy", none), box("helper", env)))
    return table(spark, sf_dir, "customer").select("c_custkey", d.main_container(containers, ["proxy"], "SIDECAR")["name"].alias("main"))


@query("SELECT n_name AS name, 'r' || n_regionkey AS region, 'linux' AS os, NULL AS zone FROM nation")
def N4_node_tags(spark, sf_dir):
    labels = F.create_map(F.lit(d.NODE_LABELS["region"]), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.lit(d.NODE_LABELS["os"]), F.lit("linux"))
    tags = d.node_tags(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), labels.alias("labels")))
    return tags.select("name", "region", "os", "zone")


@query("SELECT c_custkey FROM customer WHERE NOT (c_custkey % 2 = 0 AND c_mktsegment = 'MACHINERY') AND NOT (c_custkey % 2 = 1 AND c_nationkey = 3)")
def N5_full_sync(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pod = F.col("c_custkey") % 2 == 0
    shaped = c.select("c_custkey", F.when(pod, "pod").otherwise("node").alias("type"), F.when(F.col("c_mktsegment") == "MACHINERY", "Succeeded").otherwise("Running").alias("phase"), (F.col("c_nationkey") == 3).alias("terminated"))
    return d.full_sync(shaped).select("c_custkey")


def _changes(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return d.delta_events(e.select(F.lit("ns").alias("namespace"), F.col("user_id").cast("string").alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("event"), F.when(F.col("event_type") == "view", "Failed").otherwise("Running").alias("phase"), "value"), "1 hour")


_DELTA = """delta AS (SELECT epoch_ms(ts) // 3600000 * 3600000 AS batch, CAST(user_id AS VARCHAR) AS name, max_by(event_id, (ts, event_id)) AS seq FROM events GROUP BY ALL),
    acted AS (SELECT batch, name, seq, CASE WHEN event_type IN ('error', 'view') THEN 'del' ELSE 'add' END AS action, value FROM delta JOIN events ON event_id = seq)"""


@query(f"WITH {_DELTA} SELECT CAST(batch AS BIGINT) AS batch, name, seq, action FROM acted")
def N6_delta_sync(spark, sf_dir):
    return _changes(spark, sf_dir).select(F.unix_millis("batch").alias("batch"), "name", "seq", "action")


@query(f"""WITH {_DELTA}, last AS (SELECT name, max_by(action, batch) AS action, max_by(value, batch) AS value FROM acted GROUP BY name)
    SELECT CAST(c_custkey AS VARCHAR) AS name, c_acctbal AS value FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT name FROM last) UNION ALL SELECT name, value FROM last WHERE action = 'add'""")
def N6_apply_delta(spark, sf_dir):
    snapshot = table(spark, sf_dir, "customer").select(F.lit("ns").alias("namespace"), F.col("c_custkey").cast("string").alias("name"), F.col("c_acctbal").alias("value"))
    return d.apply_delta(snapshot, _changes(spark, sf_dir)).select("name", "value")


@query("SELECT c_custkey, c_mktsegment AS app, 'a' || c_nationkey AS owner, '' AS zone, c_name AS pod FROM customer")
def N7_task_tags(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    targets = c.select("c_custkey", F.create_map(F.lit("pod"), F.col("c_name")).alias("meta"), F.create_map(F.lit("app"), F.col("c_mktsegment")).alias("labels"), F.create_map(F.lit("own/er"), F.concat(F.lit("a"), F.col("c_nationkey").cast("string"))).alias("annotations"))
    refs = {"app": "labels.app", "owner": "annotations.own/er", "zone": "zone", "pod": "pod"}
    return d.task_tags(targets, refs).select("c_custkey", *[F.col("tags")[t].alias(t) for t in refs])
