"""Dimension operators on rows that the driver's tables do not have."""

from pyspark.sql import functions as F

from millrace.operators import dimensions as d


def test_delta_keeps_events_without_a_time(spark):
    rows = [("ns", "a", None, 1, "update"), ("ns", "a", None, 3, "delete"), ("ns", "a", "2024-01-01 00:30:00", 2, "update"), ("ns", "b", None, 4, "update")]
    events = spark.createDataFrame(rows, "namespace string, name string, at string, seq long, event string")
    events = events.select("namespace", "name", F.col("at").cast("timestamp").alias("ts"), "seq", "event", F.lit("Running").alias("phase"))
    found = d.delta_events(events, "1 hour").select(F.col("batch").cast("string"), "name", "seq", "action").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(None, "a", 3, "del"), ("2024-01-01 00:00:00", "a", 2, "add"), (None, "b", 4, "add")], key=str)
