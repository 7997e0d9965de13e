"""Transforms of metric tables (name, tags, ts, value)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.dialect import plain_groups


def allow_deny(df: DataFrame, allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """Rows whose name is allowed, if there is such a list, and not denied."""
    df = df.filter(F.col("name").isin(allow)) if allow else df
    return df.filter(~F.col("name").isin(deny)) if deny else df


def align(df: DataFrame, interval_ms: int, previous: bool = True) -> DataFrame:
    """Samples stamped with the start of their period, or of the one before it."""
    start = F.unix_millis("ts") - F.pmod(F.unix_millis("ts"), F.lit(interval_ms))
    return df.withColumn("ts", F.timestamp_millis(start - (interval_ms if previous else 0)))


def series_key(name: Column, tags: Column) -> Column:
    """name,k=v,... with keys in order: equal for the samples of one series."""
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat_ws(",", F.array(name), pairs)


def delta(df: DataFrame, interval_ms: int, keep_negative: bool = False) -> DataFrame:
    """Each sample less the one exactly an interval before it in its series; without one it is dropped, a fall counts as 0.

    A join on (series, time) instead of a window: no series is gathered.
    """
    keyed = df.withColumn("series", series_key(F.col("name"), F.col("tags")))
    before = keyed.groupBy("series", F.timestamp_millis(F.unix_millis("ts") + interval_ms).alias("ts")).agg(F.max("value").alias("previous"))
    change = F.col("value") - F.col("previous")
    return keyed.join(before, ["series", "ts"]).withColumn("value", change if keep_negative else F.greatest(change, F.lit(0.0))).select(*df.columns)


def rate(df: DataFrame, interval_ms: int, keep_negative: bool = False) -> DataFrame:
    """delta for each second of the interval."""
    return delta(df, interval_ms, keep_negative).withColumn("value", F.col("value") / (interval_ms / 1000))


def with_missing(tags: Column, extra: Column) -> Column:
    """tags, and those of extra whose keys it lacks."""
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce(tags, none)
    return F.map_concat(F.map_filter(F.coalesce(extra, none), lambda k, _: ~F.map_contains_key(own, k)), own)


def merge_tags(df: DataFrame, task_tags: dict[str, str], targets: DataFrame | None = None, on: str = "target") -> DataFrame:
    """Tags of the task, then of the target (target, target_tags), fill the keys that a sample lacks."""
    pairs = [F.lit(t) for kv in task_tags.items() for t in kv]
    df = df.withColumn("tags", with_missing(F.col("tags"), F.create_map(*pairs) if pairs else F.lit(None)))
    if targets is None:
        return df
    return df.join(targets, on, "left").withColumn("tags", with_missing(F.col("tags"), F.col("target_tags"))).drop("target_tags")


def divide(metrics: Column, a: str, b: str) -> Column:
    """metrics[a] / metrics[b]; 0 if b is missing or 0."""
    below = metrics[b]
    return F.when(below.isNull() | (below == 0), 0.0).otherwise(metrics[a] / below)


def derive(df: DataFrame, expressions: dict[str, Column]) -> DataFrame:
    """One row for each expression and (ts, tags); expressions see result, the map of names to values, and tags."""
    key = series_key(F.lit(""), F.col("tags"))
    once = df.groupBy("ts", key.alias("tag_key"), "name").agg(F.max("value").alias("value"), F.to_json(F.first("tags")).alias("tag_json"))
    wide = once.groupBy("ts", "tag_key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("result"), F.first("tag_json").alias("tag_json"))
    wide = wide.withColumn("tags", F.from_json("tag_json", "map<string,string>"))
    made = F.array(*[F.struct(F.lit(n).alias("name"), e.cast("double").alias("value")) for n, e in expressions.items()])
    return wide.select("ts", "tags", F.inline(made)).filter("value is not null").select("name", "tags", "ts", "value")


def rename(df: DataFrame, prefix: str = "", pattern: str = "") -> DataFrame:
    """Names with a prefix, or else through a printf pattern."""
    name = F.concat(F.lit(prefix), F.col("name")) if prefix else F.format_string(pattern, F.col("name")) if pattern else F.col("name")
    return df.withColumn("name", name)


def metric_name(base: str, value: str) -> str:
    """The name of one value of a metric."""
    if value == "value":
        return base
    if "%s" in base:
        return base.replace("%s", value)
    return base + value if base.endswith((".", "_")) else f"{base}_{value}"


def base_name(gateway: str | None, task_key: str, kind: str) -> str:
    """The metric name of a task: configured, or its key without the source type at its end."""
    return gateway or task_key.removesuffix(f"_{kind}").removesuffix(f".{kind}")


def to_narrow(df: DataFrame, base: str, keys: list[str], values: list[str], ts: str = "window_start") -> DataFrame:
    """Wide rows as (name, tags, ts, value); keys become tags in order of name."""
    tags = F.create_map(*[c for k in sorted(keys) for c in (F.lit(k), F.coalesce(F.col(k).cast("string"), F.lit("")))]) if keys else F.create_map().cast("map<string,string>")
    each = F.array(*[F.struct(F.lit(metric_name(base, v)).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
    return df.select(tags.alias("tags"), F.col(ts).alias("ts"), F.inline(each)).select("name", "tags", "ts", "value")


def flatten_fields(df: DataFrame) -> DataFrame:
    """(measurement, fields MAP<string,string>, tags, ts) as metrics; fields that are no numbers are left out."""
    each = df.select("measurement", "tags", "ts", F.explode("fields").alias("field", "text"))
    name = F.when(F.col("field") == "", F.col("measurement")).otherwise(F.concat_ws("_", "measurement", "field"))
    return each.select(name.alias("name"), "tags", "ts", F.col("text").try_cast("double").alias("value")).filter("value is not null")


def suppress_tags(tags: Column, keys: list[str]) -> Column:
    return F.map_filter(tags, lambda k, _: ~k.isin(keys))


def label_reference(tags: Column, key: str, labels: Column, names: list[str], default: str) -> Column:
    """tags with key set, where it is missing, to the first label of names that is not empty, or the default."""
    value = F.coalesce(*[F.nullif(labels[n], F.lit("")) for n in names], F.lit(default))
    return with_missing(tags, F.create_map(F.lit(key), value))


def relabel(labels: Column, rules: list[dict]) -> tuple[Column, Column]:
    """(labels after the rules, whether the sample stays). Actions: replace, keep, drop, labelmap, labeldrop, labelkeep."""
    stays = F.lit(True)
    for rule in rules:
        action = rule.get("action", "replace")
        pattern, names = plain_groups(rule.get("regex", "(.*)"))
        whole = f"^(?:{pattern})$"
        source = F.concat_ws(rule.get("separator", ";"), F.array(*[F.coalesce(labels[s], F.lit("")) for s in rule.get("sourceLabels", [])]))
        if action in ("keep", "drop"):
            stays = stays & (source.rlike(whole) if action == "keep" else ~source.rlike(whole))
        elif action == "replace":
            made = _replacement(source, whole, rule.get("replacement", "$1"), len(names))
            others = F.map_filter(labels, _key_is(rule["targetLabel"], False))
            replaced = F.when(made == "", others).otherwise(F.map_concat(others, F.create_map(F.lit(rule["targetLabel"]), made)))
            labels = F.when(source.rlike(whole), replaced).otherwise(labels)
        elif action == "labelmap":
            # In the order of their names; of labels that get one name the last one stays.
            matched = F.array_sort(F.map_entries(F.map_filter(labels, _key_fits(whole, True))))
            renamed = last_of_each(F.transform(matched, _entry_renamed(whole, rule.get("replacement", "$1"), len(names))))
            labels = F.map_concat(F.map_filter(labels, _key_missing(renamed)), renamed)
        elif action in ("labeldrop", "labelkeep"):
            labels = F.map_filter(labels, _key_fits(whole, action == "labelkeep"))
        else:
            raise ValueError(f"unknown action {action!r}")
    return labels, stays


def _key_is(name: str, wanted: bool):
    return lambda k, v: (k == name) == F.lit(wanted)


def _key_fits(pattern: str, wanted: bool):
    return lambda k, v: k.rlike(pattern) == F.lit(wanted)


def _key_missing(other: Column):
    return lambda k, v: ~F.map_contains_key(other, k)


def _entry_renamed(pattern: str, template: str, count: int):
    return lambda e: F.struct(_replacement(e["key"], pattern, template, count).alias("key"), e["value"].alias("value"))


def last_of_each(entries: Column) -> Column:
    """map of array<struct<key, value>>; a key that is repeated has its last value."""
    after = lambda i: F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(0)))
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(after(i), lambda x: x["key"] == e["key"])))


def _replacement(source: Column, pattern: str, template: str, count: int) -> Column:
    parts = re.split(r"\$\{?(\d+)\}?", template)
    return F.concat(*[F.regexp_extract(source, pattern, int(p)) if i % 2 and int(p) <= count else F.lit("" if i % 2 else p) for i, p in enumerate(parts)])


_SAMPLE = r"^([A-Za-z_:][\w:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+(-?\d+))?\s*$"


def exposition(line: Column) -> Column:
    """struct<name, tags, value> of a line of exposition text; NULL for comments, other lines and NaN. A repeated label has its last value; escapes in values are undone."""
    pairs = F.regexp_extract_all(F.regexp_extract(line, _SAMPLE, 2), F.lit(r'([A-Za-z_]\w*)="((?:[^"\\]|\\.)*)"'), F.lit(0))
    tags = last_of_each(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), _unescaped(F.regexp_extract(p, '^[^=]*="(.*)"$', 1)).alias("value"))))
    value = F.regexp_extract(line, _SAMPLE, 3).try_cast("double")
    return F.when(line.rlike(_SAMPLE) & value.isNotNull() & ~F.isnan(value), F.struct(F.regexp_extract(line, _SAMPLE, 1).alias("name"), tags.alias("tags"), value.alias("value")))


def _unescaped(value: Column) -> Column:
    # Between escaped backslashes, so that none of them is read as the start of another escape.
    parts = F.split(value, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))), "\\")


def datapoints(df: DataFrame, text: str = "datapoints") -> DataFrame:
    """JSON arrays of objects as metrics: timestamp is the time, strings are tags, numbers are values with lower-case names."""
    points = df.select(*[c for c in df.columns if c != text], F.explode(F.from_json(text, "array<map<string,variant>>")).alias("point"))
    kinds = F.transform_values("point", lambda _, v: F.schema_of_variant(v))
    rest = points.withColumn("kinds", kinds)
    strings = F.map_filter("point", lambda k, _: (F.col("kinds")[k] == "STRING") & (k != "timestamp"))
    tags = F.transform_values(strings, lambda _, v: F.try_variant_get(v, "$", "string"))
    numbers = F.map_filter("point", lambda k, _: F.col("kinds")[k].rlike("^(BIGINT|DOUBLE|DECIMAL)") & (k != "timestamp"))
    ts = F.timestamp_millis(F.try_variant_get(F.col("point")["timestamp"], "$", "bigint"))
    each = rest.select(*[c for c in df.columns if c != text], tags.alias("tags"), ts.alias("ts"), F.explode(F.transform_values(numbers, lambda _, v: F.try_variant_get(v, "$", "double"))).alias("field", "value"))
    return each.withColumn("name", F.lower("field")).drop("field")


def fan_out(df: DataFrame, prefix: str, namespace: str, aggregations: list[str]) -> DataFrame:
    """(name, ts, tags, values MAP) as one series for each wanted aggregation that is there."""
    each = df.select("name", "ts", "tags", F.explode(F.array(*[F.lit(a) for a in aggregations])).alias("agg"), "values")
    name = F.concat_ws("_", F.lit(prefix), F.lit(namespace.replace("-", "_")), "name", F.lower("agg"))
    return each.select(name.alias("name"), "tags", "ts", F.col("values")[F.col("agg")].alias("value")).filter("value is not null")


def increment(df: DataFrame, marks: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """Rows not loaded yet: from a minute after the last one of their keys (marks: keys, last), 5 minutes at most, up to the last full minute."""
    minute = F.date_trunc("minute", now)
    end = minute - F.expr("interval 1 minute")
    start = F.greatest(F.coalesce(F.col("last") + F.expr("interval 1 minute"), end - F.expr("interval 5 minutes")), end - F.expr("interval 5 minutes"))
    return df.join(marks, keys, "left").filter((F.col("ts") >= start) & (F.col("ts") <= end)).drop("last")


def counters(df: DataFrame, by: list[str]) -> DataFrame:
    """(table, key, value, mode, ts) rolled up by mode: sum, avg (whole numbers), max, gauge (the last value)."""
    rolled = df.groupBy(*by, "mode").agg(F.sum("value").alias("s"), F.count("value").alias("n"), F.max("value").alias("m"), F.max_by("value", "ts").alias("g"))
    value = F.when(F.col("mode") == "avg", F.expr("s div n")).when(F.col("mode") == "max", F.col("m")).when(F.col("mode") == "gauge", F.col("g")).otherwise(F.col("s"))
    return rolled.select(*by, "mode", value.alias("value"))


def vector_counters(df: DataFrame, by: list[str], width: int) -> DataFrame:
    """Element-wise sums of arrays of one width; others are ignored."""
    fit = df.filter(F.size("values") == width)
    return fit.groupBy(*by).agg(F.array(*[F.sum(F.col("values")[i]) for i in range(width)]).alias("values"))


def outcomes(df: DataFrame, by: list[str], ok: Column, cost: Column) -> DataFrame:
    """Counts and costs of successes and failures."""
    return df.groupBy(*by).agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("fail"), F.coalesce(F.sum(F.when(ok, cost)), F.lit(0.0)).alias("success_cost"), F.coalesce(F.sum(F.when(~ok, cost)), F.lit(0.0)).alias("fail_cost"))
