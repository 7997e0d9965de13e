"""Queries of metric-table transforms; the metric table is daily event counts by user and type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import metrics as m
from millrace.queries.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DAY_MS = 86_400_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name: event type, tags {team}, ts: day, value: events)."""
    e = table(spark, sf_dir, "events")
    by = e.groupBy("event_type", (F.col("user_id") % 5).cast("string").alias("team"), F.date_trunc("day", "ts").cast("timestamp").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return by.select(F.col("event_type").alias("name"), F.create_map(F.lit("team"), F.col("team")).alias("tags"), "ts", "value")


DAILY = "daily AS (SELECT event_type AS name, CAST(user_id % 5 AS VARCHAR) AS team, date_trunc('day', ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL)"
MS = "CAST(epoch_ms(ts) AS BIGINT) AS ts"


def _flat(df: DataFrame) -> DataFrame:
    return df.select("name", F.col("tags")["team"].alias("team"), F.unix_millis("ts").alias("ts"), "value")


@query(f"WITH {DAILY} SELECT name, team, {MS}, value FROM daily WHERE name IN ('error', 'view')")
def M1_allow_deny(spark, sf_dir):
    return _flat(m.allow_deny(daily(spark, sf_dir), ["error", "view", "click"], ["click"]))


@query("SELECT event_id, CAST(epoch_ms(ts) // 3600000 * 3600000 - 3600000 AS BIGINT) AS ts FROM events")
def M2_align(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return m.align(e, 3_600_000).select("event_id", F.unix_millis("ts").alias("ts"))


_PAIRS = "daily AS now JOIN daily AS old ON now.name = old.name AND now.team = old.team AND old.ts = now.ts - INTERVAL 1 DAY"


@query(f"WITH {DAILY} SELECT now.name, now.team, CAST(epoch_ms(now.ts) AS BIGINT) AS ts, greatest(now.value - old.value, 0) AS value FROM {_PAIRS}")
def M3_delta(spark, sf_dir):
    return _flat(m.delta(daily(spark, sf_dir), DAY_MS))


@query(f"WITH {DAILY} SELECT now.name, now.team, CAST(epoch_ms(now.ts) AS BIGINT) AS ts, round((now.value - old.value) / 86400 * 1e6, 4) AS value FROM {_PAIRS}")
def M4_rate(spark, sf_dir):
    return _flat(m.rate(daily(spark, sf_dir), DAY_MS, keep_negative=True).withColumn("value", F.round(F.col("value") * 1e6, 4)))


@query(f"WITH {DAILY} SELECT name || ',a=1,team=' || team AS series, count(*) AS n FROM daily GROUP BY ALL")
def M5_series_key(spark, sf_dir):
    tags = F.map_concat("tags", F.create_map(F.lit("a"), F.lit("1")))
    return daily(spark, sf_dir).groupBy(m.series_key(F.col("name"), tags).alias("series")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, 'shop' AS app, coalesce(c_mktsegment, 'none') AS segment FROM events LEFT JOIN customer ON user_id = c_custkey""")
def M6_merge_tags(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("target"), F.create_map(F.lit("app"), F.lit("shop")).alias("tags"))
    targets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target"), F.create_map(F.lit("app"), F.lit("other"), F.lit("segment"), F.col("c_mktsegment")).alias("target_tags"))
    merged = m.merge_tags(m.merge_tags(e, {"app": "task"}, targets), {"segment": "none"})
    return merged.select("event_id", F.col("tags")["app"].alias("app"), F.col("tags")["segment"].alias("segment"))


@query(f"""WITH {DAILY}, wide AS (SELECT team, ts, max(value) FILTER (name = 'error') AS e, max(value) FILTER (name = 'view') AS v FROM daily GROUP BY ALL)
    SELECT 'error_share' AS name, team, {MS}, round(CASE WHEN v IS NULL OR v = 0 THEN 0 ELSE e / v END, 6) AS value FROM wide WHERE v IS NULL OR v = 0 OR e IS NOT NULL
    UNION ALL SELECT 'both' AS name, team, {MS}, e + v AS value FROM wide WHERE e IS NOT NULL AND v IS NOT NULL""")
def M7_derive(spark, sf_dir):
    result = F.col("result")
    return _flat(m.derive(daily(spark, sf_dir), {"error_share": F.round(m.divide(result, "error", "view"), 6), "both": result["error"] + result["view"]}))


@query(f"WITH {DAILY} SELECT 'shop_' || name AS name, team, {MS}, value FROM daily")
def M8_rename(spark, sf_dir):
    return _flat(m.rename(daily(spark, sf_dir), "shop_"))


@query("""WITH w AS (SELECT event_type AS kind, date_trunc('day', ts) AS ts, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL)
    SELECT 'shop_users' AS name, kind, CAST(epoch_ms(ts) AS BIGINT) AS ts, CAST(users AS DOUBLE) AS value FROM w UNION ALL SELECT 'shop_n', kind, CAST(epoch_ms(ts) AS BIGINT), CAST(n AS DOUBLE) FROM w""")
def M9_M10_to_narrow(spark, sf_dir):
    wide = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), F.date_trunc("day", "ts").cast("timestamp").alias("window_start")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    narrow = m.to_narrow(wide, m.base_name(None, "shop_log", "log"), ["kind"], ["n", "users"])
    return narrow.select("name", F.col("tags")["kind"].alias("kind"), F.unix_millis("ts").alias("ts"), "value")


@query("SELECT o_orderkey, 'order_total' AS name, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'order', CAST(o_custkey AS DOUBLE) FROM orders")
def M11_flatten_fields(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    fields = F.create_map(F.lit("total"), F.col("o_totalprice").cast("string"), F.lit("status"), F.col("o_orderstatus"), F.lit(""), F.col("o_custkey").cast("string"))
    shaped = o.select(F.lit("order").alias("measurement"), fields.alias("fields"), F.create_map(F.lit("key"), F.col("o_orderkey").cast("string")).alias("tags"), F.col("o_orderdate").alias("ts"))
    return m.flatten_fields(shaped).select(F.col("tags")["key"].cast("long").alias("o_orderkey"), "name", "value")


_CUSTOMER_TAGS = lambda: F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string"))


@query("SELECT c_custkey, '{\"nation\":\"' || c_nationkey || '\"}' AS tags FROM customer")
def M12_suppress_tags(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.to_json(m.suppress_tags(_CUSTOMER_TAGS(), ["segment"])).alias("tags"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 0 THEN 'n' || c_nationkey ELSE 'none' END AS app FROM customer")
def M13_label_reference(spark, sf_dir):
    labels = F.create_map(F.lit("app"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(""), F.lit("owner"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))))
    tags = m.label_reference(F.create_map().cast("map<string,string>"), "app", labels, ["app", "owner"], "none")
    return table(spark, sf_dir, "customer").select("c_custkey", tags["app"].alias("app"))


@query("SELECT c_custkey, substr(c_mktsegment, 1, 3) || '-' || c_nationkey AS code, NULL AS segment, CAST(c_nationkey AS VARCHAR) AS x_nation FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'")
def M14_relabel(spark, sf_dir):
    rules = [
        {"action": "drop", "sourceLabels": ["segment"], "regex": "HOUSE.*"},
        {"sourceLabels": ["segment", "nation"], "regex": "(.{3}).*;(.*)", "targetLabel": "code", "replacement": "$1-$2"},
        {"action": "labelmap", "regex": "(nation)", "replacement": "x_$1"},
        {"action": "labeldrop", "regex": "segment"},
    ]
    labels, stays = m.relabel(_CUSTOMER_TAGS(), rules)
    shaped = table(spark, sf_dir, "customer").select("c_custkey", labels.alias("l"), stays.alias("s")).filter("s")
    return shaped.select("c_custkey", F.col("l")["code"].alias("code"), F.col("l")["segment"].alias("segment"), F.col("l")["x_nation"].alias("x_nation"))


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS kept, map_size FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none' END AS c_mktsegment, 1 AS map_size FROM customer)")
def M14_labelmap_onto_one_name(spark, sf_dir):
    # Two labels get one name: the last by name stays.
    labels = F.create_map(F.lit("x_a"), F.lit("none"), F.lit("x_b"), F.when((F.col("c_custkey") % 2 == 0) & (F.col("c_mktsegment") != "BUILDING"), F.col("c_mktsegment")).otherwise("none"))
    mapped, _ = m.relabel(labels, [{"action": "labelmap", "regex": "x_.", "replacement": "kept"}, {"action": "labelkeep", "regex": "kept"}])
    return table(spark, sf_dir, "customer").select("c_custkey", mapped.alias("l")).select("c_custkey", F.col("l")["kept"].alias("kept"), F.size("l").alias("map_size"))


@query("SELECT event_id, event_type AS last, 'a' || chr(92) || 'n' || chr(10) || '\"' || user_id AS text FROM events")
def M15_repeated_and_escaped(spark, sf_dir):
    # A label that is repeated has its last value; escaped backslash, line end and quote.
    line = F.concat(F.lit('m{x="first",t="a\\\\n\\n\\"'), F.col("user_id"), F.lit('",x="'), F.col("event_type"), F.lit('"} 3'))
    found = table(spark, sf_dir, "events").select("event_id", m.exposition(line).alias("s"))
    return found.select("event_id", F.col("s.tags")["x"].alias("last"), F.col("s.tags")["t"].alias("text"))


@query("SELECT event_id, event_type || '_cost' AS name, CAST(user_id AS VARCHAR) AS \"user\", CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value FROM events WHERE event_id % 4 <> 0 AND event_id % 5 <> 0")
def M15_exposition(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    number = F.when(F.col("event_id") % 5 == 0, "NaN").otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    line = F.when(F.col("event_id") % 4 == 0, "# HELP cost").otherwise(F.concat("event_type", F.lit('_cost{user="'), F.col("user_id"), F.lit('",unit="eur"} '), number))
    found = e.select("event_id", m.exposition(line).alias("s")).filter("s is not null")
    return found.select("event_id", F.col("s.name").alias("name"), F.col("s.tags")["user"].alias("user"), F.col("s.value").alias("value"))


@query("SELECT event_id, 'k' AS name, event_type AS kind, CAST(epoch_ms(date_trunc('second', ts)) AS BIGINT) AS ts, CAST(props ->> '$.k' AS DOUBLE) AS value FROM events")
def M16_datapoints(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) * 1000
    text = F.concat(F.lit('[{"timestamp": '), seconds.cast("string"), F.lit(', "kind": "'), F.col("event_type"), F.lit('", "K": '), F.get_json_object("props", "$.k"), F.lit("}]"))
    points = m.datapoints(e.select("event_id", text.alias("datapoints")))
    return points.select("event_id", "name", F.col("tags")["kind"].alias("kind"), F.unix_millis("ts").alias("ts"), "value")


@query("""WITH s AS (SELECT event_type, round(min(value), 4) AS lo, round(max(value), 4) AS hi FROM events GROUP BY 1)
    SELECT 'cloud_my_ns_' || event_type || '_minimum' AS name, lo AS value FROM s UNION ALL SELECT 'cloud_my_ns_' || event_type || '_maximum', hi FROM s""")
def M17_fan_out(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.create_map(F.lit("Minimum"), F.round(F.min("value"), 4), F.lit("Maximum"), F.round(F.max("value"), 4)).alias("values"))
    s = s.withColumns({"ts": F.lit(None).cast("timestamp"), "tags": F.create_map().cast("map<string,string>")})
    return m.fan_out(s, "cloud", "my-ns", ["Minimum", "Maximum", "Average"]).select("name", "value")


@query("""WITH marks AS (SELECT user_id, max(ts) AS last FROM events WHERE ts < TIMESTAMP '2024-01-15 11:57:30' AND user_id % 2 = 0 GROUP BY 1)
    SELECT event_id FROM events LEFT JOIN marks USING (user_id)
    WHERE ts <= TIMESTAMP '2024-01-15 11:59:00' AND ts >= greatest(coalesce(last + INTERVAL 1 MINUTE, TIMESTAMP '2024-01-15 11:54:00'), TIMESTAMP '2024-01-15 11:54:00')""")
def M18_increment(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    marks = e.filter("ts < timestamp'2024-01-15 11:57:30' and user_id % 2 = 0").groupBy("user_id").agg(F.max("ts").alias("last"))
    return m.increment(e, marks, F.lit("2024-01-15 12:00:20").cast("timestamp"), ["user_id"]).select("event_id")


@query("""WITH c AS (SELECT user_id AS key, CASE event_type WHEN 'click' THEN 'avg' WHEN 'error' THEN 'max' WHEN 'view' THEN 'gauge' ELSE 'sum' END AS mode, CAST(floor(value) AS BIGINT) AS v, ts FROM events)
    SELECT key, mode, CAST(CASE mode WHEN 'avg' THEN sum(v) // count(*) WHEN 'max' THEN max(v) WHEN 'gauge' THEN max_by(v, ts) ELSE sum(v) END AS BIGINT) AS value FROM c GROUP BY key, mode""")
def M19_counters(spark, sf_dir):
    mode = F.when(F.col("event_type") == "click", "avg").when(F.col("event_type") == "error", "max").when(F.col("event_type") == "view", "gauge").otherwise("sum")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), mode.alias("mode"), F.floor("value").alias("value"), "ts")
    return m.counters(e, ["key"])


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS lines, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1")
def M20_vector_counters(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pair = F.array(F.col("l_linenumber").cast("double"), F.col("l_quantity").cast("double"))
    shaped = li.select("l_returnflag", F.when(F.col("l_orderkey") % 10 == 0, F.array(F.lit(1.0))).otherwise(pair).alias("values"))
    return m.vector_counters(shaped, ["l_returnflag"], 2).select("l_returnflag", F.col("values")[0].cast("long").alias("lines"), F.col("values")[1].alias("quantity"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus <> 'F') AS fail,
    round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS success_cost, round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END), 2) AS fail_cost FROM orders GROUP BY 1""")
def M21_outcomes(spark, sf_dir):
    o = m.outcomes(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return o.withColumns({c: F.round(c, 2) for c in ("success_cost", "fail_cost")})
