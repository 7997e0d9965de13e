"""What became of the records: drop funnels and window status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stages in which a record can end, in order.
STAGES = ("broken", "ignored", "pre_where", "parse", "vars", "time", "where", "group", "late", "keys_cap", "select", "processed")


def stage_of(tests: list[tuple[str, Column]]) -> Column:
    """The first stage whose test is not true, or processed."""
    found = None
    for stage, passed in tests:
        failed = ~F.coalesce(passed, F.lit(False))
        found = F.when(failed, stage) if found is None else found.when(failed, stage)
    return F.lit("processed") if found is None else found.otherwise("processed")


def funnel(staged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Records of each stage, over all or for each window."""
    return staged.groupBy(*(by or []), "stage").agg(F.count(F.lit(1)).alias("records"))


def window_status(staged: DataFrame, watermark: Column, interval_ms: int, start: str = "window_start", opened: Column | None = None) -> DataFrame:
    """Counters of each window and whether it is complete: the watermark has reached its end, and the source was opened before its start."""
    counts = [F.count_if(F.col("stage") == s).alias(s) for s in STAGES]
    return staged.groupBy(start).agg(*counts).withColumn("ok", complete(start, watermark, interval_ms, opened))


def complete(start: str, watermark: Column, interval_ms: int, opened: Column | None = None) -> Column:
    end = F.timestamp_millis(F.unix_millis(start) + interval_ms)
    return (watermark >= end) & (F.lit(True) if opened is None else opened <= F.col(start))


def every_window(status: DataFrame, first: Column, last: Column, watermark: Column, interval_ms: int, start: str = "window_start", opened: Column | None = None) -> DataFrame:
    """status with a row for each window from first to last: empty ones have counters of 0 and are as complete as their times say."""
    windows = status.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr(f"interval {interval_ms} milliseconds"))).alias(start))
    counters = [c for c in status.columns if c not in (start, "ok")]
    return windows.join(status.drop("ok"), start, "left").select(start, *[F.coalesce(c, F.lit(0)).alias(c) for c in counters], complete(start, watermark, interval_ms, opened).alias("ok"))
