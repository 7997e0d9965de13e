"""Windowed aggregates of records, with their caps and samples."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import expressions
from millrace.functions.expressions import Scope, keeps

MOST_KEYS = 100_000
MOST_SAMPLES, MOST_SAMPLE_BYTES = 100, 1 << 16


def interval_ms(interval: float | str) -> int:
    """Milliseconds of a number or of a duration such as 5s, 100ms, 1m30s."""
    text = str(interval).strip()
    if re.fullmatch(r"\d+(\.\d+)?", text):
        return int(float(text))
    units = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h|d)", text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {interval!r}")
    return int(sum(float(n) * units[u] for n, u in parts))


def window_start(ts: Column, interval: float | str) -> Column:
    """Start of the tumbling window, aligned to the epoch."""
    ms = F.unix_millis(ts)
    return F.timestamp_millis(ms - F.pmod(ms, F.lit(interval_ms(interval)).cast("long")))


def finite(value: Column) -> Column:
    """NaN and infinities count as 0."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, however often later steps use it; a projection would be merged into them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def cell(conf: dict, scope: Scope) -> Column:
    """What one row gives to a selected value, NULL where its condition or its number fails."""
    accepted, kind = keeps(conf.get("where"), scope), conf.get("agg") or "count"
    if kind == "count":
        return F.when(accepted, F.lit(1.0))
    if kind == "hll":
        return F.when(accepted, F.xxhash64(expressions.text(conf.get("elect"), scope)).cast("double"))
    return F.when(accepted, expressions.numeric(conf.get("elect"), scope))


def total(conf: dict, value: Column) -> Column:
    """A selected value of a group; nothing accepted is 0."""
    kind = conf.get("agg") or "count"
    if kind == "count":
        return F.count(value)
    if kind == "hll":
        return F.approx_count_distinct(value)
    return F.coalesce({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[kind](finite(value)), F.lit(0.0))


def value_names(values: list[dict]) -> list[str]:
    """Names of the values; a single one is called value."""
    return ["value"] if len(values) == 1 else [v["as"] for v in values]


def arrival(df: DataFrame) -> Column:
    """Sort key of the order in which rows came: by the age of their file, its path, and their place in it."""
    return F.struct(*[c for c in ("file_time", "path", "block", "ord") if c in df.columns])


def aggregate(df: DataFrame, values: list[dict], keys: list[str], scope: Scope, start: str = "window_start", most_keys: int = 0) -> DataFrame:
    """One row for each window and group that any record reached; with most_keys, for each window's first groups by arrival."""
    kind = lambda v: v.get("agg") if v.get("agg") in (None, "count", "hll") else "number"
    keyed = [json.dumps([kind(v), kind(v) and v.get("elect"), v.get("where")], sort_keys=True) for v in values]
    cells = {k: cell(v, scope) for k, v in zip(keyed, values, strict=True)}
    place = {k: f"c{i}" for i, k in enumerate(cells)}
    capped = most_keys > 0 and keys
    if capped:
        df = df.withColumn("seen_at", arrival(df))
    df = once(df, "cells", F.struct(*[c.alias(place[k]) for k, c in cells.items()]))
    columns = [total(v, F.col("cells")[place[k]]).alias(n) for v, n, k in zip(values, value_names(values), keyed, strict=True)]
    if not capped:
        return df.groupBy(start, *keys).agg(*columns)
    grouped = df.groupBy(start, *keys).agg(*columns, F.min("seen_at").alias("seen_at"))
    return earliest(grouped, [start], ["seen_at", *keys], keys, min(most_keys, MOST_KEYS)).drop("seen_at")


#: Parts of a window or group that are ranked on their own before it is.
PARTS = 32


def earliest(rows: DataFrame, by: list[str], order: list[str], spread: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group `by`: of its parts, dealt by a hash of `spread`, first, and then of the parts' firsts."""
    rows = rows.withColumn("rank_part", F.pmod(F.xxhash64(*spread), F.lit(PARTS)))
    for parts in ([*by, "rank_part"], by):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*order))).filter(F.col("rank") <= most).drop("rank")
    return rows.drop("rank_part")


def partials(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """Mergeable parts of one value: total, n, least, most and a distinct-count sketch."""
    return df.groupBy(*by).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.hll_sketch_agg(value.cast("string")).alias("sketch"))


def merge_partials(parts: DataFrame, by: list[str]) -> DataFrame:
    """Parts of any number of sources and windows merged into final values."""
    merged = parts.groupBy(*by).agg(F.sum("total").alias("sum"), F.sum("n").alias("count"), F.min("least").alias("min"), F.max("most").alias("max"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    return merged.withColumn("avg", F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0))


def kept_keys(df: DataFrame, keys: list[str], limit: int, start: str = "window_start") -> DataFrame:
    """(window, keys): each window's first `limit` keys by arrival. Only one row for each key is ranked."""
    seen = df.groupBy(start, *keys).agg(F.min(arrival(df)).alias("seen_at"))
    return earliest(seen, [start], ["seen_at", *keys], keys, min(limit, MOST_KEYS)).select(start, *keys)


def first_keys(df: DataFrame, keys: list[str], limit: int, start: str = "window_start") -> DataFrame:
    """Rows of each window's first `limit` keys by arrival; no limit if it is 0 or less."""
    if limit <= 0 or not keys:
        return df
    kept = kept_keys(df, keys, limit, start)
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(kept[c]) for c in (start, *keys)])
    return df.join(kept, same, "left_semi")


def cut_bytes(text: Column, most: int) -> Column:
    """At most so many bytes of a text."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string")))


def sample_limits(conf: dict) -> tuple[int, int]:
    """How many records a group's samples are, and how many bytes of each line stay."""
    return min(MOST_SAMPLES, conf.get("maxCount") or 10), min(MOST_SAMPLE_BYTES, conf.get("maxLength") or 4096)


def sampled(df: DataFrame, conf: dict, scope: Scope) -> Column:
    """The lines of a record cut for a sample; NULL if it is none."""
    return F.when(keeps(conf.get("where"), scope), F.transform("lines", lambda x: cut_bytes(x, sample_limits(conf)[1])))


def samples_json(logs: Column, conf: dict, scope: Scope) -> Column:
    """{maxCount, samples: [{hostname, logs}]} of the logs of sampled records."""
    host = scope.meta.get("hostname", F.lit(""))
    each = F.transform(logs, lambda x: F.struct(host.alias("hostname"), x.alias("logs")))
    return F.to_json(F.struct(F.lit(sample_limits(conf)[0]).alias("maxCount"), each.alias("samples")))


def samples(df: DataFrame, conf: dict, keys: list[str], scope: Scope, start: str = "window_start") -> DataFrame:
    """First records by arrival of each window and group: log_samples.

    Rows are ranked within hashed parts of a group first, so that a large group is many
    tasks and only maxCount rows of each part are ranked again.
    """
    by = [start, *keys]
    rows = df.select(*by, arrival(df).alias("seen_at"), sampled(df, conf, scope).alias("logs")).filter("logs is not null")
    rows = earliest(rows, by, ["seen_at"], ["seen_at"], sample_limits(conf)[0])
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("seen_at", "logs"))).alias("all"))
    return listed.select(*by, samples_json(F.transform("all", lambda x: x["logs"]), conf, scope).alias("log_samples"))
