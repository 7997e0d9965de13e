"""Deltas of metric streams, with the last samples of each series kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators.metrics import series_key
from millrace.streaming.windows import keep_state


class SeriesDelta(StatefulProcessor):
    """Each sample of a series less the one exactly an interval before it.

    The samples of one interval are kept, and let go once the watermark is keep_ms past
    them. A sample that is older than the newest one by an interval or more has come too late to
    be a base; it still gets its own delta if its base is there.
    """

    def __init__(self, interval_ms: int, keep_negative: bool, keep_ms: int):
        self.interval, self.negative, self.keep = interval_ms, keep_negative, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts array<bigint>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows), ignore_index=True).sort_values("ms", kind="stable")
        old = self.last.get()
        known = dict(zip(old[0], old[1], strict=True)) if old else {}
        fresh = table.dropna(subset=["value"]).groupby("ms")["value"].max()
        for ms, value in fresh.items():
            known[ms] = max(value, known.get(ms, value))
        base = table["ms"].map(lambda ms: known.get(ms - self.interval))
        change = table["value"] - base.astype(float)
        table = table.assign(value=change if self.negative else change.clip(lower=0))
        newest = max(known, default=0)
        kept = {ms: v for ms, v in known.items() if ms > newest - self.interval or ms == newest}
        self.last.update((list(kept), list(kept.values())))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(newest + self.keep)
        yield table[base.notna()][["name", "tags", "ms", "value"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"name": pd.Series(dtype=object), "tags": pd.Series(dtype=object), "ms": pd.Series(dtype="int64"), "value": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


def stream_delta(metrics: DataFrame, interval_ms: int, keep_negative: bool = False, delay: str = "10 seconds", keep_ms: int | None = None) -> DataFrame:
    """delta of operators.metrics for a stream of (name, tags, ts, value): without a sample an interval before it a sample is dropped, a fall counts as 0.

    delay: how far the times of all series may be out of order. keep_ms: how long a series
    without samples is remembered, by the watermark; ten intervals by default. Sets the
    session's state store.
    """
    keep_state(metrics.sparkSession)
    flat = metrics.withWatermark("ts", delay).select(series_key(F.col("name"), F.col("tags")).alias("series"), "name", F.to_json("tags", {"ignoreNullFields": "false"}).alias("tags"), F.unix_millis("ts").alias("ms"), F.col("value").cast("double").alias("value"))
    held = SeriesDelta(interval_ms, keep_negative, keep_ms or 10 * interval_ms)
    found = flat.groupBy("series").transformWithStateInPandas(held, "name string, tags string, ms long, value double", "Append", "EventTime")
    return found.select("name", F.from_json("tags", "map<string,string>").alias("tags"), F.timestamp_millis("ms").alias("ts"), "value")


def stream_rate(metrics: DataFrame, interval_ms: int, keep_negative: bool = False, delay: str = "10 seconds", keep_ms: int | None = None) -> DataFrame:
    """stream_delta for each second of the interval."""
    return stream_delta(metrics, interval_ms, keep_negative, delay, keep_ms).withColumn("value", F.col("value") / (interval_ms / 1000))
