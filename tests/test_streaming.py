"""Streams give what the same rows give in batch."""

import pytest
from pyspark.sql import functions as F

from millrace.plans.task import LogTask
from millrace.sources import growing, logs
from millrace.streaming import multiline, sinks, tasks

COST = {"type": "leftRight", "leftRight": {"left": "cost=", "right": " "}}
LEVEL = {"type": "leftRight", "leftRight": {"leftIndex": 1, "left": " ", "right": " "}}


def task(**more):
    values = [{"as": "n", "agg": "count"}, {"as": "total", "agg": "sum", "elect": COST}]
    return LogTask({"select": {"values": values}, "from": {"log": {"time": {"type": "auto"}}}, "groupBy": {"groups": [{"name": "level", "elect": LEVEL}], **more}, "window": {"interval": "5s"}})


def write(path, seconds):
    path.mkdir(exist_ok=True)
    lines = [f"2024-01-01 00:{s // 60:02d}:{s % 60:02d} {'INFO' if s % 3 else 'WARN'} cost={s} end" for s in seconds]
    (path / f"{seconds[0]}.log").write_text("\n".join([*lines, "", "no time"]) + "\n")


def collect(spark, df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name)


def test_windows_late_rows_and_first_window(spark, tmp_path):
    write(tmp_path / "in", list(range(0, 60)))
    batch = task().run(logs.read_log_lines(spark, [str(tmp_path / "in")]))
    stream = tasks.run_stream(task(), logs.stream_log_lines(spark, str(tmp_path / "in")))
    got = {tuple(r) for r in collect(spark, stream, tmp_path, "windows").collect()}
    want = {tuple(r) for r in batch.select(*stream.columns).collect()}
    closed = {r for r in want if r[0].second < 55}
    # The last window waits for the watermark to pass it.
    assert closed <= got <= want
    late = tasks.run_stream(task(), logs.stream_log_lines(spark, str(tmp_path / "in")), first_window=F.lit("2024-01-01 00:00:05").cast("timestamp"))
    assert min(r[0].second for r in collect(spark, late, tmp_path, "first").collect()) == 5


def test_details(spark, tmp_path):
    write(tmp_path / "in", list(range(0, 20)))
    detailed = task(details={"enabled": True})
    stream = tasks.run_stream(detailed, logs.stream_log_lines(spark, str(tmp_path / "in")))
    batch = detailed.run(logs.read_log_lines(spark, [str(tmp_path / "in")]))
    assert sorted(map(tuple, collect(spark, stream, tmp_path, "details").collect())) == sorted(map(tuple, batch.collect()))


def test_sinks(spark, tmp_path):
    write(tmp_path / "in", list(range(0, 20)))
    detailed = task(details={"enabled": True})
    rows = tasks.run_stream(detailed, logs.stream_log_lines(spark, str(tmp_path / "in")))
    metrics = rows.select(F.lit("cost").alias("name"), F.create_map(F.lit("level"), "level").alias("tags"), "ts", F.col("total").alias("value"))
    both = sinks.fan_out([sinks.metric_table(str(tmp_path / "m")), sinks.detail_table(str(tmp_path / "d"))])
    sinks.start(metrics, both, str(tmp_path / "c")).awaitTermination(120)
    m, d = str(tmp_path / "m"), str(tmp_path / "d")
    days = lambda: sorted((str(r["date"]), r["count"]) for r in sinks.read_table(spark, m).groupBy("date").count().collect())
    assert days() == [("2024-01-01", 20)] and sinks.read_table(spark, d).count() == 20
    # The same batch again replaces all it wrote: with other dates, fewer rows, and none.
    again = sinks.read_table(spark, m).select("name", "tags", "ts", "value").persist()
    first = again.orderBy("value").limit(3)
    sinks.metric_table(m)(again.union(first.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))), 0)
    assert days() == [("2024-01-01", 20), ("2024-01-02", 3)]
    sinks.metric_table(m)(first, 0)
    assert days() == [("2024-01-01", 3)]
    # Another batch and another task are beside it.
    sinks.metric_table(m)(first, 1)
    sinks.metric_table(m, task="other")(first, 0)
    assert days() == [("2024-01-01", 9)]
    for batch in (0, 1):
        sinks.metric_table(m)(first.limit(0), batch)
    assert days() == [("2024-01-01", 3)]
    sinks.detail_table(d)(first.limit(0), 0)
    assert sinks.read_table(spark, d).count() == 0
    assert len(list((tmp_path / "m" / "content").iterdir())) == 3


def test_growing_files(spark, tmp_path):
    folder = tmp_path / "grow"
    folder.mkdir()
    a, b = folder / "a.log", folder / "b.log"
    got = lambda: sorted((r["path"].rsplit("/", 1)[1], r["ord"], r["line"]) for r in spark.read.parquet(str(tmp_path / "grown")).collect())
    want = []

    def step(text, path=a, mode="a", names=None):
        """Appends text, runs what has come and compares with the lines that are whole."""
        with open(path, mode) as f:
            f.write(text)
        lines = growing.stream_growing_lines(spark, f"{folder}/*.log", split_bytes=16)
        query = lines.writeStream.foreachBatch(lambda df, n: df.select("path", "ord", "line").write.mode("append").parquet(str(tmp_path / "grown"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        want.extend(names or [])
        assert got() == sorted(want)

    step("one\ntwo\nthr", names=[("a.log", 0, "one"), ("a.log", 4, "two")])
    step("ee\n", names=[("a.log", 8, "three")])
    step("", names=[])
    step("a line longer than two splits of a file are\nshort\n\n", b, names=[("b.log", 0, "a line longer than two splits of a file are"), ("b.log", 44, "short"), ("b.log", 50, "")])
    # Renamed files are not read again, the new file of the name is.
    a.rename(folder / "a.1.log")
    step("fresh\n", names=[("a.log", 0, "fresh")])
    # One that is cut short is read from its start.
    step("cut\n", b, "w", names=[("b.log", 0, "cut")])


@pytest.mark.parametrize(("what", "want"), [("previous", [["H1", "a", "b"], ["H2", "c"], ["H3"]]), ("next", [["H1"], ["a", "b", "H2"], ["c", "H3"]])])
def test_multiline(spark, tmp_path, what, want):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.log").write_text("H1\na\nb\nH2\nc\nH3\n")
    lines = logs.stream_log_lines(spark, str(folder), ordered=True)
    records = multiline.stream_multiline(lines, "^H", negate=True, what=what, idle_ms=1500)
    query = records.writeStream.format("memory").queryName(f"records_{what}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        # Timers keep the stream busy, so it is polled.
        for _ in range(40):
            if spark.table(f"records_{what}").count() >= len(want):
                break
            query.awaitTermination(1)
        assert query.exception() is None
        got = [r["lines"] for r in spark.table(f"records_{what}").orderBy("ord").collect()]
    finally:
        query.stop()
    assert got == want


def test_growing_files_in_few_tasks(tmp_path):
    """Tasks do not grow with the number of splits; each line is read once, with its place."""
    want = []
    for name in "ab":
        text = [f"{name} {k} " + "x" * (k % 40) for k in range(3000)]
        (tmp_path / f"{name}.log").write_text("\n".join(text) + "\n")
        at = 0
        for line in text:
            want.append((str(tmp_path / f"{name}.log"), at, line))
            at += len(line) + 1
    reader = growing.GrowingReader({"path": f"{tmp_path}/*.log", "splitBytes": "32"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) <= growing.TASKS + 4
    got = [(r["path"], r["ord"], r["value"]) for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    assert sorted(got) == sorted(want)
