"""Queries of snapshot-derived metrics; snapshots are running event counts by host and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import snapshots as s
from millrace.queries.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
TYPES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(host, ts: day, one running count for each event type)."""
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).alias("host"), F.date_trunc("day", "ts").cast("timestamp").alias("ts")).agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in TYPES])
    w = Window.partitionBy("host").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.select("host", "ts", *[F.sum(t).over(w).alias(t) for t in TYPES])


_COUNTS = ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES)
#: Changes between days; d_ms of the days.
CHANGES = f"""d AS (SELECT user_id % 5 AS host, date_trunc('day', ts) AS day, {_COUNTS} FROM events GROUP BY ALL),
    c AS (SELECT *, epoch_ms(day) - lag(epoch_ms(day)) OVER (PARTITION BY host ORDER BY day) AS d_ms, CAST(epoch_ms(day) AS BIGINT) AS ts FROM d)"""


def _ms(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.unix_millis("ts"))


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return _ms(df).withColumns({c: F.round(c, 6) for c in columns})


#: Ten modes out of five counts: user and nice hold guest and guest_nice.
_MODES = {"user": "2 * click", "system": "error", "idle": "view", "nice": "2 * purchase", "iowait": "signup", "irq": "3 * click", "softirq": "2 * error", "steal": "2 * signup", "guest": "click", "guest_nice": "purchase"}
_SHARES = {"user": "click", "nice": "purchase", **{c: v for c, v in _MODES.items() if c not in ("user", "nice")}, "busy": "total - view", "util": "6 * click + 3 * error + 2 * purchase"}


@query(f"""WITH {CHANGES}, t AS (SELECT *, 5 * click + 3 * error + 2 * purchase + 3 * signup + view AS total FROM c) SELECT host, ts, {", ".join(f"round(100.0 * ({v}) / total, 6) AS cpu_{c}" for c, v in _SHARES.items())}
    FROM t WHERE d_ms IS NOT NULL AND total > 0""")
def H1_cpu_shares(spark, sf_dir):
    df = running(spark, sf_dir).select("host", "ts", *[F.expr(v).alias(c) for c, v in _MODES.items()])
    return _round(s.cpu_shares(df, ["host"]), *[f"cpu_{c}" for c in _SHARES])


@query(f"WITH {CHANGES} SELECT host, ts, CAST(click * 100000 * 1000 // d_ms AS BIGINT) AS click_rate FROM c WHERE d_ms > 0")
def H2_counter_rates(spark, sf_dir):
    df = running(spark, sf_dir).withColumn("click", F.col("click") * 100_000)
    return _ms(s.counter_rates(df, ["host"], ["click"]))


@query(f"""WITH {CHANGES}, t AS (SELECT host % 2 AS machine, day, sum(view) AS view, sum(error) AS error FROM d GROUP BY ALL), q AS (SELECT *, epoch_ms(day) - lag(epoch_ms(day)) OVER (PARTITION BY machine ORDER BY day) AS dm FROM t)
    SELECT machine, CAST(epoch_ms(day) AS BIGINT) AS ts, CAST(view * 1000000 * 1000 // dm AS BIGINT) AS view_rate, CAST(error * 1000000 * 1000 // dm AS BIGINT) AS error_rate FROM q WHERE dm > 0""")
def H3_traffic_rates(spark, sf_dir):
    df = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5 % 2).alias("machine"), (F.col("user_id") % 5).alias("interface"), F.date_trunc("day", "ts").cast("timestamp").alias("ts")).agg(*[(1_000_000 * F.count_if(F.col("event_type") == t)).alias(t) for t in ("view", "error")])
    machine = df.groupBy("machine", "ts").agg(F.sum("view").alias("view"), F.sum("error").alias("error"))
    w = Window.partitionBy("machine").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = machine.select("machine", "ts", *[F.sum(c).over(w).alias(c) for c in ("view", "error")])
    halves = total.select("machine", "ts", F.explode(F.array(F.struct(F.col("view").alias("view"), F.col("error").alias("error")), F.struct(F.lit(0).cast("long").alias("view"), F.lit(0).cast("long").alias("error")))).alias("x")).select("machine", "ts", "x.*")
    return _ms(s.traffic_rates(halves, ["machine"], ["view", "error"]))


@query(f"""WITH {CHANGES} SELECT host, ts, CAST(click * 1000000 * 1000 // d_ms AS BIGINT) AS in_rate, CAST(view * 1000000 * 1000 // d_ms AS BIGINT) AS out_rate, round(CASE WHEN click + view > 0 THEN 100.0 * error / (click + view) ELSE 0 END, 6) AS retrans_percent,
    CAST(signup * 2000000 * 1000 // d_ms AS BIGINT) AS active_opens_rate, CAST(purchase * 3000000 * 1000 // d_ms AS BIGINT) AS in_datagrams_rate, host + 7 AS curr_estab FROM c WHERE d_ms > 0""")
def H4_tcp_rates(spark, sf_dir):
    df = running(spark, sf_dir).select("host", "ts", *[(F.col(c) * 1_000_000).alias(n) for c, n in (("click", "in_segs"), ("view", "out_segs"), ("error", "retrans_segs"))], (F.col("signup") * 2_000_000).alias("active_opens"), (F.col("purchase") * 3_000_000).alias("in_datagrams"), (F.col("host") + 7).alias("curr_estab"))
    return _round(s.tcp_rates(df, ["host"]), "retrans_percent")


@query(f"WITH {CHANGES} SELECT host % 2 AS machine, CAST(epoch_ms(day) AS BIGINT) AS ts, CAST(sum(click + view) AS BIGINT) AS total, CAST(sum(click) AS BIGINT) AS used, round(CASE WHEN sum(click + view) > 0 THEN 100.0 * sum(click) / sum(click + view) ELSE 0 END, 6) AS util FROM d GROUP BY ALL")
def H5_disk_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5 % 2).alias("machine"), (F.col("user_id") % 5).alias("disk"), F.date_trunc("day", "ts").cast("timestamp").alias("ts"))
    df = e.agg(F.count_if(F.col("event_type").isin("click", "view")).alias("total"), F.count_if(F.col("event_type") == "click").alias("used"))
    return _round(s.disk_rollup(df, ["machine"]), "util")


@query("""SELECT o_orderkey, CAST(epoch_ms(o_orderdate::TIMESTAMP) AS BIGINT) AS ts, o_totalprice AS mem_total, CAST(o_custkey AS DOUBLE) AS mem_avail, CAST(o_custkey % 7 AS BIGINT) AS swap_free, CAST(o_custkey % 5 AS DOUBLE) AS load_load1,
    round(CASE WHEN o_totalprice > 0 THEN 100.0 * (o_totalprice - o_custkey) / o_totalprice ELSE 0 END, 6) AS mem_rutil FROM orders""")
def H6_memory_and_load(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("total"), F.col("o_custkey").cast("double").alias("available"), (F.col("o_custkey") % 7).cast("long").alias("swap_free"), (F.col("o_custkey") % 5).cast("double").alias("load1"))
    return _round(s.memory_and_load(o, ["o_orderkey"]), "mem_rutil")


@query("SELECT l_suppkey, count(*) AS processes, CAST(sum(l_linenumber) AS BIGINT) AS threads FROM lineitem GROUP BY 1")
def H7_process_totals(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", F.lit(None).cast("timestamp").alias("ts"), F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("threads"))
    return s.process_totals(df, ["l_suppkey"]).drop("ts")


#: Each cumulative counter runs as one of the counts, times a million and its number.
_JVM = {name: (TYPES[k % 5], (k + 1) * 1_000_000) for k, name in enumerate(s.JVM)}
_PERF = {new: old for old, new in s.JVM_NAMES.items()}


@query(f"""WITH {CHANGES} SELECT host, ts, {", ".join(f"CASE WHEN d_ms IS NOT NULL THEN round({c} * {n} / {1e9 if name in s.JVM_NANOS else 1.0}, 6) END AS {name}" for name, (c, n) in _JVM.items())},
    CAST(sum(view) OVER (PARTITION BY host ORDER BY ts) AS BIGINT) AS eden_used FROM c""")
def H8_jvm_deltas(spark, sf_dir):
    df = running(spark, sf_dir).select("host", "ts", F.col("view").alias(_PERF["eden_used"]), *[(F.col(c) * n).alias(_PERF[name]) for name, (c, n) in _JVM.items()])
    found = s.jvm_deltas(df, ["host"])
    return _ms(found).withColumns({c: F.round(F.col(c).cast("double"), 6) for c in _JVM})


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes FROM part")
def H8_heap_bytes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    unit = F.element_at(F.array(F.lit(""), F.lit("k"), F.lit("m"), F.lit("G")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return p.select("p_partkey", s.heap_bytes(F.concat(F.col("p_size").cast("string"), unit)).alias("bytes"))


@query(f"""WITH {CHANGES} SELECT host, ts, round(CASE WHEN error + signup > 0 THEN least(100, 100.0 * click * 1e12 / (d_ms * 1e6) / CASE WHEN host % 2 = 0 THEN 0.5 ELSE 4 END) END, 6) AS cpu_util,
    CAST(1000 - host AS BIGINT) AS mem_used, round(100.0 * (1000 - host) / CASE WHEN host > 2 THEN 1500 ELSE 2000 END, 6) AS mem_util FROM c WHERE d_ms > 0""")
def H9_container_usage(spark, sf_dir):
    df = running(spark, sf_dir).select("host", "ts", F.lit("m").alias("machine"), (F.col("click") * 1_000_000_000_000).alias("cpu_ns"), F.col("error").alias("user_ns"), F.col("signup").alias("system_ns"),
        F.when(F.col("host") % 2 == 0, 50_000).alias("quota"), F.lit(100_000).alias("period"), F.lit(1000).cast("long").alias("mem_usage"), F.col("host").cast("long").alias("mem_cache"), F.when(F.col("host") > 2, 1500).otherwise(5000).alias("mem_limit"))
    machines = spark.createDataFrame([("m", 4, 2000)], "machine string, cores int, memory long")
    return _round(s.container_usage(df, machines, ["host"]), "cpu_util", "mem_util")


@query(f"WITH {CHANGES} SELECT host, ts, round(view * 1000000 * 1000.0 / d_ms, 6) AS traffic_bytin, round(click * 1000000 * 1000.0 / d_ms, 6) AS traffic_bytout, host + 3 AS tcp_established, CAST(2 AS BIGINT) AS tcp_listen FROM c WHERE d_ms > 0")
def H10_interface_traffic(spark, sf_dir):
    sockets = {"tcp_established": F.col("host"), "tcp6_established": F.lit(3), "tcp_listen": F.lit(1).cast("long"), "tcp6_listen": F.lit(1).cast("long")}
    both = running(spark, sf_dir).withColumn("interface", F.explode(F.array(F.lit("eth0"), F.lit("lo"))))
    df = both.select("host", "ts", "interface", (F.col("view") * 1_000_000).alias("rx_bytes"), (F.col("click") * 1_000_000).alias("tx_bytes"), *[v.alias(c) for c, v in sockets.items()])
    return _round(s.interface_traffic(df, ["host"]), "traffic_bytin", "traffic_bytout")


@query("""WITH p AS (SELECT '/pods/n' || c_nationkey AS path, NULL AS kind FROM customer UNION SELECT '/pods/n' || c_nationkey || '/c' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'sandbox' ELSE 'container' END FROM customer UNION SELECT '/', NULL UNION SELECT '/empty', NULL)
    SELECT path, CASE WHEN path = '/' THEN 'node' WHEN kind = 'sandbox' THEN 'network' WHEN kind = 'container' THEN 'container' WHEN path LIKE '/pods/n%' THEN 'pod' ELSE 'other' END AS role FROM p""")
def H11_cgroup_roles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    pod = F.concat(F.lit("/pods/n"), F.col("c_nationkey").cast("string"))
    leaves = c.select(F.concat(pod, F.lit("/c"), F.col("c_custkey").cast("string")).alias("path"), F.when(F.col("c_custkey") % 3 == 0, "sandbox").otherwise("container").alias("kind"))
    pods = c.select(pod.alias("path"), F.lit(None).cast("string").alias("kind")).distinct()
    rest = spark.createDataFrame([("/", None), ("/empty", None)], "path string, kind string")
    return s.cgroup_roles(leaves.union(pods).union(rest)).select("path", "role")


@query("""WITH e AS (SELECT event_id, user_id, event_id // 400 AS source, value FROM events), f AS (SELECT *, CASE WHEN source IS DISTINCT FROM lag(source) OVER (PARTITION BY user_id ORDER BY event_id) THEN value END AS fresh FROM e)
    SELECT event_id, last_value(fresh IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM f""")
def H12_carry_forward(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("ts"), "user_id", F.floor(F.col("event_id") / 400).alias("source"), "value")
    return s.carry_forward(e, ["user_id"], "value", "source").select("event_id", "value")


@query("SELECT user_id % 5 AS node, CAST(epoch_ms(date_trunc('day', ts)) AS BIGINT) AS ts, count(*) AS containers FROM events GROUP BY ALL")
def H13_containers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("node"), F.date_trunc("day", "ts").cast("timestamp").alias("ts"), F.col("event_id").alias("container"))
    return _ms(s.node_containers(e, ["node"]))


@query("""WITH k AS (SELECT user_id, 'c' || (event_id % 3) AS container, date_trunc('day', ts) AS minute FROM events WHERE event_type = 'error' AND event_id % 10 <> 0),
    days AS (SELECT unnest(generate_series((SELECT min(date_trunc('day', ts)) FROM events), (SELECT max(date_trunc('day', ts)) FROM events), INTERVAL 1 DAY)) AS minute)
    SELECT user_id, container, CAST(epoch_ms(minute) AS BIGINT) AS minute, count(*) AS count FROM k GROUP BY ALL
    UNION ALL SELECT c_custkey, '-', CAST(epoch_ms(minute) AS BIGINT), 0 FROM customer, days WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = c_custkey AND k.minute = days.minute)""")
def H14_zero_fill(spark, sf_dir):
    every = table(spark, sf_dir, "events")
    first, last = every.agg(F.min("ts").cast("timestamp"), F.max("ts").cast("timestamp")).first()
    e = every.filter("event_type = 'error'").select("user_id", F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("container"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 10 == 0).alias("sandbox"))
    pods = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return s.with_zero_fill(e, pods, ["user_id"], F.lit(first), F.lit(last), 86_400_000).withColumn("minute", F.unix_millis("minute"))


@query("SELECT p_partkey, round(p_size * CASE p_partkey % 4 WHEN 0 THEN 1048576.0 WHEN 1 THEN 0.01 WHEN 2 THEN 1.0 ELSE 1073741824.0 END, 4) AS value FROM part")
def H15_gpu_values(spark, sf_dir):
    unit = F.element_at(F.array(F.lit(" MiB"), F.lit(" %"), F.lit(" W"), F.lit(" GiB")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(s.gpu_value(F.concat(F.col("p_size").cast("string"), unit)), 4).alias("value"))


@query("SELECT user_id, max(CASE WHEN event_type = 'view' AND regexp_matches(props, '7') THEN 1 ELSE 0 END) AS up, 1 - max(CASE WHEN event_type = 'view' AND regexp_matches(props, '7') THEN 1 ELSE 0 END) AS down, CAST(floor(avg(event_id)) AS BIGINT) AS cost FROM events GROUP BY 1")
def H16_probe_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", 200).otherwise(500)
    return s.probe_rollup(e.select("user_id", s.http_up(status, F.col("props"), [200, 204], "7").alias("up"), F.col("event_id").alias("cost_ms")), ["user_id"])


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS BIGINT) * 1048576 ELSE 0 END AS meta_max, CASE p_partkey % 3 WHEN 1 THEN 0 ELSE CAST(p_size AS BIGINT) * 1024 END AS code FROM part")
def H8_command_sizes(spark, sf_dir):
    size = F.col("p_size").cast("string")
    meta = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-XX:MaxMetaspaceSize="), size, F.lit("m"))).when(F.col("p_partkey") % 3 == 1, "-XX:MaxMetaspaceSize=all").otherwise("-Xmx1g")
    code = F.when(F.col("p_partkey") % 3 == 1, "-server").otherwise(F.concat(F.lit("-XX:ReservedCodeCacheSize="), size, F.lit("k")))
    # Of an option given twice the last one counts.
    command = F.array(F.lit("java"), F.when(F.col("p_partkey") % 3 == 0, "-XX:MaxMetaspaceSize=1g").otherwise("-Xss1m"), meta, code)
    found = table(spark, sf_dir, "part").select("p_partkey", s.command_sizes(command).alias("x"))
    return found.select("p_partkey", F.col("x.meta_max").alias("meta_max"), F.col("x.reserved_code_cache_size").alias("code"))


@query("""WITH gpus AS (SELECT user_id AS host, event_id % 4 AS gpu, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS v, event_id FROM events)
    SELECT host, name, index, round(value, 4) AS value, count(*) AS n FROM (
        SELECT host, 'gpu_power' AS name, CAST(gpu AS VARCHAR) AS index, v AS value FROM gpus UNION ALL SELECT host, 'gpu_memory', CAST(gpu AS VARCHAR), v * 1048576 FROM gpus WHERE event_id % 3 <> 0
        UNION ALL SELECT host, 'system_gpu_count', NULL, count(*) FROM gpus GROUP BY host) GROUP BY ALL""")
def H15_gpu_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    number = F.col("value").cast("decimal(18,2)").cast("string")
    line = F.concat((F.col("event_id") % 4).cast("string"), F.lit(", "), number, F.lit(" W, "), F.when(F.col("event_id") % 3 == 0, "[N/A]").otherwise(F.concat(number, F.lit(" MiB"))))
    rows = s.gpu_metrics(e.select(F.col("user_id").alias("host"), line.alias("line")), ["host"], ["gpu_power", "gpu_memory"])
    return rows.withColumn("value", F.round("value", 4)).groupBy("host", "name", "index", "value").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CHANGES}, m AS (SELECT host, ts, 'COUNT' AS statistic, CAST(click AS DOUBLE) AS value FROM c WHERE d_ms IS NOT NULL UNION ALL SELECT host, ts, 'MAX', CAST(view AS DOUBLE) FROM c)
    SELECT host, ts, statistic, value FROM m""")
def H17_actuator(spark, sf_dir):
    r = running(spark, sf_dir)
    w = Window.partitionBy("host").orderBy("ts")
    plain = F.col("view") - F.coalesce(F.lag("view").over(w), F.lit(0))
    shaped = r.withColumn("plain", plain).select("host", "ts", F.inline(F.array(F.struct(F.lit("COUNT").alias("statistic"), F.col("click").cast("double").alias("value")), F.struct(F.lit("MAX").alias("statistic"), F.col("plain").cast("double").alias("value")))))
    return _ms(s.actuator_deltas(shaped, ["host"]))
