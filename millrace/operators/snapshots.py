"""Metrics from periodic snapshots of cumulative counters.

Input tables have one row for each entity and time; what is derived compares a row with
the one before it, found by lag over the entity, and drops the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.aggregate import window_start

#: Columns of the CPU modes.
CPU = ("user", "system", "idle", "nice", "iowait", "irq", "softirq", "steal", "guest", "guest_nice")
# Names of JVM performance counters and of their metrics, the cumulative ones, and of them those in nanoseconds.
JVM_NAMES = {
    "sun.gc.generation.0.space.0.used": "eden_used", "sun.gc.generation.0.space.0.capacity": "eden_capacity", "sun.gc.generation.0.space.0.maxCapacity": "eden_max",
    "sun.gc.generation.1.space.0.used": "old_used", "sun.gc.generation.1.space.0.capacity": "old_capacity", "sun.gc.generation.1.space.0.maxCapacity": "old_max",
    "sun.gc.metaspace.used": "meta_used", "sun.gc.metaspace.capacity": "meta_capacity", "sun.gc.metaspace.maxCapacity": "meta_max",
    "sun.gc.compressedclassspace.used": "compressedclass_used", "sun.gc.compressedclassspace.capacity": "compressedclass_capacity",
    "sun.gc.generation.2.space.0.used": "perm_used", "sun.gc.generation.2.space.0.capacity": "perm_capacity", "sun.gc.generation.2.space.0.maxCapacity": "perm_max",
    "sun.gc.collector.0.invocations": "ygc_count", "sun.gc.collector.0.time": "ygc_time", "sun.gc.collector.1.invocations": "fgc_count", "sun.gc.collector.1.time": "fgc_time",
    "java.threads.started": "thread_started", "java.threads.live": "thread_live", "java.threads.daemon": "thread_daemon", "java.threads.livePeak": "thread_live_peak",
    "sun.rt.safepoints": "safepoints", "sun.rt.safepointTime": "safepoint_time", "sun.rt.safepointSyncTime": "safepoint_sync_time", "sun.rt.applicationTime": "application_time",
    "sun.rt._sync_Parks": "parks", "sun.rt._sync_Notifications": "notifications", "sun.rt._sync_MonExtant": "mon_extant", "sun.rt._sync_Inflations": "inflations",
    "sun.rt._sync_FutileWakeups": "futile_wakeups", "sun.rt._sync_Deflations": "deflations", "sun.rt._sync_ContendedLockAttempts": "contended_lock_attempts",
    "sun.gc.tlab.alloc": "tlab_alloc", "java.cls.loadedClasses": "loaded_classes", "java.cls.unloadedClasses": "unloaded_classes", "java.cls.sharedLoadedClasses": "shared_loaded_classes",
    "java.cls.sharedUnloadedClasses": "shared_unloaded_classes", "sun.ci.nmethodCodeSize": "nmethod_code_size", "sun.ci.nmethodSize": "nmethod_size",
}
JVM = ("ygc_count", "ygc_time", "fgc_count", "fgc_time", "thread_started", "safepoints", "safepoint_time", "safepoint_sync_time", "application_time", "parks", "notifications", "inflations", "futile_wakeups", "deflations", "contended_lock_attempts")
JVM_NANOS = ("ygc_time", "fgc_time", "safepoint_time", "safepoint_sync_time", "application_time")


def changes(df: DataFrame, entity: list[str], columns: list[str], ts: str = "ts") -> DataFrame:
    """df with d_<column>, the change since the row before, and d_ms; the first row of an entity is dropped."""
    w = Window.partitionBy(*entity).orderBy(ts)
    new = {f"d_{c}": F.col(c) - F.lag(c).over(w) for c in columns}
    new["d_ms"] = F.unix_millis(ts) - F.lag(F.unix_millis(ts)).over(w)
    return df.withColumns(new).filter("d_ms is not null")


def per_second(column: str) -> Column:
    """Change for each second, as a whole number."""
    return F.expr(f"cast(d_{column} * 1000 as bigint) div d_ms")


def cpu_shares(df: DataFrame, entity: list[str]) -> DataFrame:
    """Shares of the CPU modes in percent, cpu_busy (all but idle) and cpu_util; rows without progress are dropped.

    user and nice hold guest and guest_nice, which the total therefore leaves out; their
    own shares are without them. Modes that the table lacks are 0.
    """
    modes = [c for c in CPU if c in df.columns]
    d = changes(df, entity, modes)
    delta = lambda *names: sum((F.col(f"d_{c}") for c in names if c in modes), F.lit(0))
    d = d.withColumn("total", delta("user", "system", "nice", "iowait", "irq", "softirq", "steal", "idle")).filter("total > 0")
    share = lambda value: 100.0 * value / F.col("total")
    own = {c: delta(c) for c in modes}
    own |= {c: delta(c) - delta(guest) for c, guest in (("user", "guest"), ("nice", "guest_nice")) if c in modes}
    busy, util = F.col("total") - delta("idle"), delta("user", "system", "nice", "guest", "irq", "softirq")
    return d.select(*entity, "ts", *[share(v).alias(f"cpu_{c}") for c, v in own.items()], share(busy).alias("cpu_busy"), share(util).alias("cpu_util"))


def counter_rates(df: DataFrame, entity: list[str], columns: list[str]) -> DataFrame:
    """Whole-number rates of counters."""
    return changes(df, entity, columns).filter("d_ms > 0").select(*entity, "ts", *[per_second(c).alias(f"{c}_rate") for c in columns])


def traffic_rates(df: DataFrame, entity: list[str], columns: list[str]) -> DataFrame:
    """Rates of counters summed over the interfaces of an entity."""
    return counter_rates(df.groupBy(*entity, "ts").agg(*[F.sum(c).alias(c) for c in columns]), entity, columns)


def tcp_rates(df: DataFrame, entity: list[str]) -> DataFrame:
    """Rates of TCP counters and UDP datagrams as far as the table has them, retransmissions in percent of all segments; current connections stay."""
    segments = ["in_segs", "out_segs", "retrans_segs"]
    others = [c for c in ("active_opens", "passive_opens", "estab_resets", "attempt_fails", "in_datagrams", "out_datagrams") if c in df.columns]
    d = changes(df, entity, [*segments, *others]).filter("d_ms > 0")
    all_segments = F.col("d_in_segs") + F.col("d_out_segs")
    percent = F.when(all_segments > 0, 100.0 * F.col("d_retrans_segs") / all_segments).otherwise(0.0)
    current = [c for c in ("curr_estab",) if c in df.columns]
    return d.select(*entity, "ts", *current, per_second("in_segs").alias("in_rate"), per_second("out_segs").alias("out_rate"), percent.alias("retrans_percent"), *[per_second(c).alias(f"{c}_rate") for c in others])


def disk_rollup(df: DataFrame, entity: list[str]) -> DataFrame:
    """Total, used and used percent over the disks of an entity."""
    sums = df.groupBy(*entity, "ts").agg(F.sum("total").alias("total"), F.sum("used").alias("used"))
    return sums.withColumn("util", F.when(F.col("total") > 0, 100.0 * F.col("used") / F.col("total")).otherwise(0.0))


def used_percent(total: Column, available: Column) -> Column:
    """Memory in use, in percent."""
    return F.when(total > 0, 100.0 * (total - available) / total).otherwise(0.0)


def memory_and_load(df: DataFrame, entity: list[str]) -> DataFrame:
    """Memory, swap and load as they are, named for metrics, and mem_rutil, what is not available in percent.

    df: total, available, and any of used, free, buffers, cached, dirty, used_percent, swap_total, swap_free, swap_cached, load1, load5, load15.
    """
    names = {"total": "mem_total", "used": "mem_used", "available": "mem_avail", "free": "mem_free", "buffers": "mem_buff", "cached": "mem_cach", "dirty": "mem_dirty", "used_percent": "mem_util", "swap_total": "swap_total", "swap_free": "swap_free", "swap_cached": "swap_cach", "load1": "load_load1", "load5": "load_load5", "load15": "load_load15"}
    return df.select(*entity, "ts", *[F.col(c).alias(n) for c, n in names.items() if c in df.columns], used_percent(F.col("total"), F.col("available")).alias("mem_rutil"))


def node_containers(df: DataFrame, node: list[str]) -> DataFrame:
    """Containers of each node and time."""
    return df.groupBy(*node, "ts").agg(F.count("container").alias("containers"))


def interface_traffic(df: DataFrame, entity: list[str], interface: str = "eth0") -> DataFrame:
    """Bytes in and out a second over one interface, and TCP connections established and listening over both versions of IP.

    df: interface, rx_bytes, tx_bytes, and tcp_established, tcp6_established, tcp_listen, tcp6_listen of the entity.
    """
    d = changes(df.filter(F.col("interface") == interface), entity, ["rx_bytes", "tx_bytes"]).filter("d_ms > 0")
    rate = lambda c: F.col(f"d_{c}") * 1000.0 / F.col("d_ms")
    both = lambda state: F.col(f"tcp_{state}") + F.col(f"tcp6_{state}")
    return d.select(*entity, "ts", rate("rx_bytes").alias("traffic_bytin"), rate("tx_bytes").alias("traffic_bytout"), both("established").alias("tcp_established"), both("listen").alias("tcp_listen"))


def process_totals(df: DataFrame, entity: list[str]) -> DataFrame:
    """Processes and their threads."""
    return df.groupBy(*entity, "ts").agg(F.count("pid").alias("processes"), F.sum("threads").alias("threads"))


def jvm_deltas(df: DataFrame, entity: list[str]) -> DataFrame:
    """JVM counters under their metric names: changes of cumulative ones, falls as 0, nanoseconds as seconds, null in the first sample; all others as they are."""
    df = df.withColumnsRenamed({old: new for old, new in JVM_NAMES.items() if old in df.columns})
    w = Window.partitionBy(*entity).orderBy("ts")
    change = lambda c: F.greatest(F.col(c) - F.lag(c).over(w), F.lit(0)) / (1e9 if c in JVM_NANOS else 1)
    first = lambda c: F.when(F.lag(c).over(w).isNotNull(), change(c))
    return df.withColumns({c: first(c) for c in JVM if c in df.columns})


def heap_bytes(option: Column) -> Column:
    """Bytes of a size such as 512m or 4G. A number without a unit is bytes, as a JVM reads it; anything else is null."""
    number, unit = F.regexp_extract(option, r"^(\d+)([kKmMgG]?)$", 1).try_cast("bigint"), F.lower(F.regexp_extract(option, r"^(\d+)([kKmMgG]?)$", 2))
    return number * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)


def command_sizes(command: Column) -> Column:
    """struct<meta_max, reserved_code_cache_size>: bytes of the options in a command line (array<string>), the last of each; 0 if it has none that can be read."""

    def size(option: str) -> Column:
        found = F.filter(command, lambda x: x.startswith(option))
        return F.coalesce(heap_bytes(F.substring(F.try_element_at(found, F.lit(-1)), len(option) + 1, 64)), F.lit(0))

    return F.struct(size("-XX:MaxMetaspaceSize=").alias("meta_max"), size("-XX:ReservedCodeCacheSize=").alias("reserved_code_cache_size"))


def container_usage(df: DataFrame, machines: DataFrame, entity: list[str]) -> DataFrame:
    """CPU use of a limit in percent (100 at most) and memory less cache, for rows of (machine, entity, ts, cpu_ns, user_ns, system_ns, quota, period, mem_usage, mem_cache, mem_limit).

    The limit is quota / period, or the cores of the machine (machine, cores, memory);
    memory limits are capped by the machine's.
    """
    d = changes(df, entity, ["cpu_ns", "user_ns", "system_ns"]).filter("d_ms > 0").join(machines, "machine", "left")
    limit = F.when((F.col("quota") > 0) & (F.col("period") > 0), F.col("quota") / F.col("period")).otherwise(F.col("cores"))
    busy = F.least(F.lit(100.0), 100.0 * F.col("d_cpu_ns") / (F.col("d_ms") * 1e6) / limit)
    used = F.col("mem_usage") - F.col("mem_cache")
    memory = F.least(F.when(F.col("mem_limit") > 0, F.col("mem_limit")).otherwise(F.col("memory")), F.col("memory"))
    moved = (F.col("d_user_ns") + F.col("d_system_ns")) > 0
    return d.select(*entity, "ts", F.when(moved, busy).alias("cpu_util"), used.alias("mem_used"), (100.0 * used / memory).alias("mem_util"))


def cgroup_roles(df: DataFrame) -> DataFrame:
    """(path, kind: container, sandbox or null) with role: node, pod, network, container or other.

    The parent of a labelled leaf is a pod; the join on parents replaces a walk of the tree.
    """
    leaves = df.filter("kind is not null").select(F.regexp_replace("path", "/[^/]*$", "").alias("path")).distinct().withColumn("of_leaf", F.lit(True))
    role = F.when(F.col("path") == "/", "node").when(F.col("kind") == "sandbox", "network").when(F.col("kind") == "container", "container").when(F.col("of_leaf"), "pod").otherwise("other")
    return df.join(leaves, "path", "left").select("path", "kind", role.alias("role"))


def carry_forward(df: DataFrame, entity: list[str], value: str, source_ts: str) -> DataFrame:
    """Where the source's time did not move, the value of the last period again."""
    w = Window.partitionBy(*entity).orderBy("ts")
    moved = F.coalesce(F.col(source_ts) != F.lag(source_ts).over(w), F.lit(True))
    df = df.withColumn("fresh", F.when(moved, F.col(value)))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(value, F.last("fresh", ignorenulls=True).over(upto)).drop("fresh")


def with_zero_fill(events: DataFrame, pods: DataFrame, keys: list[str], first: Column, last: Column, every_ms: int = 60_000) -> DataFrame:
    """Counts of events by keys, container and minute; for each minute from first to last, a pod without any has container '-' and count 0.

    The rows that are filled in are made from the pods, each its own minutes.
    """
    minute = window_start(F.col("ts"), every_ms)
    counted = events.filter("not coalesce(sandbox, false)").groupBy(*keys, "container", minute.alias("minute")).agg(F.count(F.lit(1)).alias("count"))
    minutes = F.sequence(window_start(first, every_ms), window_start(last, every_ms), F.expr(f"interval {every_ms} milliseconds"))
    quiet = pods.select(*keys).distinct().withColumn("minute", F.explode(minutes)).join(counted, [*keys, "minute"], "left_anti")
    return counted.unionByName(quiet.select(*keys, F.lit("-").alias("container"), "minute", F.lit(0).cast("long").alias("count")))


def gpu_value(cell: Column) -> Column:
    """A cell such as '12 MiB', '35 %', '80.5 W' as bytes, a fraction or the plain number."""
    text = F.trim(cell)
    number = F.regexp_extract(text, r"^(-?[\d.]+)", 1).try_cast("double")
    unit = F.trim(F.regexp_extract(text, r"^-?[\d.]+\s*(.*)$", 1))
    return number * F.when(unit == "KiB", 2.0**10).when(unit == "MiB", 2.0**20).when(unit == "GiB", 2.0**30).when(unit == "TiB", 2.0**40).when(unit == "%", 0.01).otherwise(1.0)


def gpu_metrics(df: DataFrame, entity: list[str], names: list[str], line: str = "line") -> DataFrame:
    """(entity, name, index, value) of the rows that a GPU query prints, an index and a cell for each of names; and system_gpu_count of each entity, without an index.

    Cells that hold no number give nothing; a row counts whatever its cells hold.
    """
    cells = df.select(*entity, F.split(line, r"\s*,\s*", -1).alias("cells"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), gpu_value(F.get("cells", F.lit(i))).alias("value")) for i, n in enumerate(names, 1)]))
    values = cells.select(*entity, F.trim(F.get("cells", F.lit(0))).alias("index"), each.alias("m")).select(*entity, "m.name", "index", "m.value").filter("value is not null")
    counts = cells.groupBy(*entity).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return values.unionByName(counts.select(*entity, F.lit("system_gpu_count").alias("name"), F.lit(None).cast("string").alias("index"), "value"))


def probe_rollup(df: DataFrame, by: list[str]) -> DataFrame:
    """Attempts (up, cost_ms) by target: up if any was, down, and the mean cost in whole milliseconds."""
    up = F.max(F.col("up").cast("int"))
    return df.groupBy(*by).agg(up.alias("up"), (1 - up).alias("down"), F.floor(F.avg("cost_ms")).alias("cost"))


def http_up(status: Column, body: Column, statuses: list[int], pattern: str | None = None) -> Column:
    """True if the status is wanted and the body has the pattern."""
    return status.isin(statuses) & (body.rlike(pattern) if pattern else F.lit(True))


def actuator_deltas(df: DataFrame, entity: list[str]) -> DataFrame:
    """(entity, ts, statistic, value): COUNT and TOTAL_TIME as changes, other statistics as they are; first samples of changes are dropped."""
    w = Window.partitionBy(*entity, "statistic").orderBy("ts")
    cumulative = F.col("statistic").isin("COUNT", "TOTAL_TIME")
    value = F.when(cumulative, F.col("value") - F.lag("value").over(w)).otherwise(F.col("value"))
    return df.withColumn("value", value).filter("value is not null")
