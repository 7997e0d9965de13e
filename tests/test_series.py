"""Deltas and snapshots of streams against those of batches."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import dimensions, metrics
from millrace.streaming import series, sinks


def run(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return sorted(repr(tuple(r)) for r in df.sparkSession.table(name).collect())


def test_stream_delta(spark, tmp_path):
    rng = random.Random(6)
    # Ticks with gaps, falls, two samples at one time, one between ticks, and series that differ in tags only.
    rows = [(n, {"host": h}, 1_700_000_000 + 5 * k, float(rng.randint(0, 100))) for n in ("a", "b") for h in ("x", "y") for k in range(12) if rng.random() < 0.8]
    rows += [("a", {"host": "x"}, 1_700_000_000 + 5 * 3, 1000.0), ("a", {"host": "x"}, 1_700_000_002, 3.0), ("none", None, 1_700_000_000, 1.0), ("none", None, 1_700_000_005, 4.0)]
    rows.sort(key=lambda r: r[2])
    schema = "name string, tags map<string,string>, seconds long, value double"
    whole = spark.createDataFrame(rows, schema)
    shaped = lambda df: df.select("name", "tags", F.timestamp_seconds("seconds").alias("ts"), "value")
    for negative in (False, True):
        want = sorted(repr(tuple(r)) for r in metrics.delta(shaped(whole), 5000, negative).collect())
        assert len(want) > 10
        for batches in (1, 3):
            folder = tmp_path / f"in{batches}{negative}"
            size = -(-len(rows) // batches)
            for k in range(batches):
                spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").json(str(folder))
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))
            assert run(series.stream_delta(shaped(stream), 5000, negative), tmp_path, f"d{batches}{negative}") == want


def resources(rng, n):
    return [(f"n{rng.randint(0, 3)}", f"r{rng.randint(0, 25)}", rng.choice(["add", "update", "delete"]), rng.choice(["Running", "Running", "Failed", None]), 1_700_000_000 + rng.randint(0, 500), k, k % 7) for k in range(n)]


@pytest.mark.parametrize("buckets", [1, 8])
def test_snapshot_of_a_stream(spark, tmp_path, buckets):
    rng = random.Random(buckets)
    schema = "namespace string, name string, event string, phase string, seconds long, seq long, value long"
    rows = resources(rng, 300)
    path = str(tmp_path / "s")
    write = sinks.snapshot_table(path, ["namespace", "name"], ["seconds", "seq"], buckets)
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshot(spark, path)
    seen = []
    # Batches in any order of time, the second twice, an empty one, and one of events that came before.
    for number, part in enumerate((rows[:100], rows[100:180], rows[100:180], [], rows[180:], rows[:40])):
        seen += part
        write(spark.createDataFrame(part, schema), number)
        last = {}
        for r in sorted(seen, key=lambda r: r[4:6]):
            last[r[:2]] = r
        want = sorted(r for r in last.values() if r[2] != "delete" and r[3] != "Failed") if seen else []
        assert sorted(tuple(r) for r in sinks.read_snapshot(spark, path, dimensions.gone()).collect()) == sorted(want, key=lambda r: r)
