"""Windows held as state: any split into batches gives what the same rows give in batch."""

import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from millrace.plans.task import LogTask
from millrace.sources import logs
from millrace.streaming import tasks, windows

COST = {"type": "leftRight", "leftRight": {"left": "cost=", "right": " "}}
USER = {"type": "leftRight", "leftRight": {"left": "user=", "right": " "}}
VALUES = [{"as": "n", "agg": "count"}, {"as": "total", "agg": "sum", "elect": COST}, {"as": "mean", "agg": "avg", "elect": COST}, {"as": "least", "agg": "min", "elect": COST}, {"as": "users", "agg": "hll", "elect": USER}]
SAMPLES = {"enabled": True, "maxCount": 3, "maxLength": 30, "where": {"numberOp": {"elect": COST, "gte": 5}}}


def task(values=VALUES, samples=None, **group):
    select = {"values": values} | ({"logSamples": samples} if samples else {})
    return LogTask({"select": select, "from": {"log": {"time": {"type": "auto"}}}, "groupBy": {"groups": [{"name": "user", "elect": USER}]} | group, "window": {"interval": "20s"}})


def lines(n=240, users=9):
    """A line each quarter of a second; users come and go, so that windows have more of them than the cap."""
    for k in range(n):
        s = k // 4
        yield f"2024-01-01 00:{s // 60:02d}:{s % 60:02d} user=u{(k * 7 + k // 50) % users} cost={'x' if k % 13 == 0 else k % 11} call java.lang.Thing{k % 5} from {10 + k % 3}.0.0.1 end"


def in_batches(folder, rows, batches):
    """The rows in files that are read one after the other, a file for each batch."""
    folder.mkdir()
    size = -(-len(rows) // batches)
    for k in range(batches):
        path = folder / f"{k:02d}.log"
        path.write_text("\n".join(rows[k * size : (k + 1) * size]) + "\n")
        stamp = 1_700_000_000 + k
        os.utime(path, (stamp, stamp))


def by_files(spark, folder):
    """A stream that takes a file at a time, with the place of lines in them."""
    whole = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder), wholetext=True)
    at = whole.select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("ord", "line"))
    none = F.create_map().cast("map<string,string>")
    return at.select("path", F.lit(0).cast("long").alias("block"), F.col("ord").cast("long").alias("ord"), "line", none.alias("log_tags"), none.alias("path_tags"))


def collect(spark, df, tmp_path, name, **trigger):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name).collect()


CASES = {"cap": task(maxKeySize=4), "samples": task(samples=SAMPLES), "cap_and_samples": task(samples=SAMPLES, maxKeySize=2), "analysis": task([{"agg": "loganalysis"}], logAnalysis={"patterns": [{"name": "six", "where": {"numberOp": {"elect": COST, "gt": 8}}}], "maxUnknownPatterns": 3})}


@pytest.mark.parametrize("case", sorted(CASES))
def test_any_split_gives_the_batch_result(spark, tmp_path, case):
    one, rows = CASES[case], list(lines())
    # A line an hour later closes all windows but its own.
    rows.append(rows[0].replace("2024-01-01 00:", "2024-01-01 01:"))
    in_batches(tmp_path / "batch", rows, 3)
    batch = one.run(logs.read_log_lines(spark, [str(tmp_path / "batch")]))
    want = sorted(repr(tuple(r)) for r in batch.filter(F.col("window_start") < "2024-01-01 00:30:00").select(*sorted(batch.columns)).collect())
    assert len(want) >= 3
    for batches in (1, 4):
        in_batches(tmp_path / f"in{batches}", rows, batches)
        stream = tasks.run_stream(one, by_files(spark, tmp_path / f"in{batches}"))
        assert sorted(stream.columns) == sorted(batch.columns)
        assert sorted(repr(tuple(r)) for r in collect(spark, stream.select(*sorted(stream.columns)), tmp_path, f"{case}{batches}")) == want


def test_late_rows_by_window(spark, tmp_path):
    rows = list(lines(80))
    late = [*rows[:5], rows[0].replace("00:00:00", "00:05:00"), *rows[:3], rows[-1].replace("00:00:19", "00:09:00")]
    in_batches(tmp_path / "in", rows + late[:6], 1)
    for k, some in enumerate((late[6:9], late[9:], late[:2])):
        (tmp_path / "in" / f"later{k}.log").write_text("\n".join(some) + "\n")
        os.utime(tmp_path / "in" / f"later{k}.log", (1_700_000_100 + k,) * 2)
    held = windows.held_windows(task(maxKeySize=2), by_files(spark, tmp_path / "in"), "1 second")
    found = collect(spark, held.select("kind", "start", "late", "keys", "vals"), tmp_path, "late")
    counted = sum(r["late"] for r in found if r["kind"] == "late")
    assert counted == 5 and {r["start"] for r in found if r["kind"] == "late"} == {1_704_067_200_000}
    first = [r for r in found if r["kind"] == "row" and r["start"] == 1_704_067_200_000]
    assert len(first) == 2 and all(r["vals"][0] > 0 for r in first)
    # Spark's own windows drop them too; a listener adds the batches up.
    listener = tasks.LateRows()
    spark.streams.addListener(listener)
    try:
        collect(spark, tasks.run_stream(task(), by_files(spark, tmp_path / "in")), tmp_path, "plain")
        for _ in range(50):
            if listener.dropped.get("plain"):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert listener.dropped["plain"] > 0


@pytest.mark.parametrize("capped", [False, True])
def test_idle_windows_close(spark, tmp_path, capped):
    (tmp_path / "in").mkdir()
    now = datetime.now(timezone.utc)
    rows = [f"{now - timedelta(seconds=s):%Y-%m-%d %H:%M:%S} user=u{s % 2} cost=1 end" for s in (3, 2, 1)]
    (tmp_path / "in" / "a.log").write_text("\n".join(rows) + "\n")
    one = LogTask({"select": {"values": [{"as": "n", "agg": "count"}]}, "from": {"log": {"time": {"type": "auto"}}}, "groupBy": {"groups": [{"name": "user", "elect": USER}], "maxKeySize": 5 if capped else 0}, "window": {"interval": "2s"}})
    stream = tasks.run_stream(one, logs.stream_log_lines(spark, str(tmp_path / "in")), idle="3 seconds")
    query = stream.writeStream.format("memory").queryName(f"idle{capped}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            got = spark.table(f"idle{capped}").agg(F.sum("value")).first()[0]
            if got == 3:
                break
            assert query.exception() is None
            query.awaitTermination(1)
    finally:
        query.stop()
    assert got == 3


def test_estimate_of_distinct_hashes():
    import numpy as np

    hashes = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 50_000).astype(float).tolist()
    kept = set()
    for k in range(0, len(hashes), 1000):
        kept = windows.smallest(kept | set(hashes[k : k + 1000]))
    assert abs(windows.distinct(kept) / 50_000 - 1) < 0.07
    assert windows.distinct(set(hashes[:2000])) == 2000


def test_mixed_time_layouts(spark, tmp_path):
    """The layouts of a sample are tried first; a line of another one is read all the same, in batch as on streams."""
    (tmp_path / "in").mkdir()
    forms = ["2024-01-01 00:00:{:02d} user=a cost=1 end", "02/Jan/2024:00:00:{:02d} user=b cost=1 end", "17043264{:02d} user=c cost=1 end"]
    rows = [f.format(k % 60) for f in forms for k in range(300)]
    (tmp_path / "in" / "a.log").write_text("\n".join(rows) + "\n")
    one = LogTask({"select": {"values": [{"as": "n", "agg": "count"}]}, "from": {"log": {"time": {"type": "auto"}}}, "groupBy": {"groups": [{"name": "user", "elect": USER}]}, "window": {"interval": "1h"}})
    got = {r["user"]: r["value"] for r in one.run(logs.read_log_lines(spark, [str(tmp_path / "in")])).groupBy("user").agg(F.sum("value").alias("value")).collect()}
    assert got == {"a": 300, "b": 300, "c": 300}


def test_capped_parts_take_rows_in_pieces():
    """A part of a capped window holds one piece of its rows at a time, in any order, and the first groups of all parts are the window's."""
    import weakref

    import numpy as np
    import pandas as pd

    def piece(batch, rows):
        one = lambda x: np.array([float(x)])
        return pd.DataFrame([{"batch": batch, "start": 0, "keys": f'["{key}"]', "path": "p", "block": 0, "ord": place, "n": 1, "counts": one(1), "sums": one(cost), "least": one(cost), "highest": one(cost), "sets": [[]], "samples": []} for key, place, cost in rows])

    alive, most_alive = [], 0

    def pieces(*parts):
        nonlocal most_alive
        for batch, rows in parts:
            frame = piece(batch, rows)
            alive.append(weakref.ref(frame))
            most_alive = max(most_alive, sum(r() is not None for r in alive))
            yield frame
            del frame

    held = windows.HeldGroups(1000, ["sum"], 2, 0)
    content = held.empty()
    held.add(content, pieces((1, [("c", 9, 1), ("b", 5, 2)]), (1, [("a", 7, 4)]), (1, [("b", 8, 8), ("c", 1, 16)])))
    assert most_alive <= 2
    assert {k: v["sum"] for k, v in content.items()} == {'["c"]': [17.0], '["b"]': [10.0]}
    # Later groups come behind, whatever their place.
    held.add(content, pieces((2, [("d", 0, 1), ("c", 0, 32)])))
    assert {k: v["sum"] for k, v in content.items()} == {'["c"]': [49.0], '["b"]': [10.0]}
    rows = held.frame([{"kind": "row", "start": 0, "late": 0, **r} for r in held.rows(content)])
    other = held.frame([{"kind": "row", "start": 0, "late": 0, "keys": ["e"], "vals": [3.0], "samples": [], "batch": 1, "path": "p", "block": 0, "ord": 2}])
    late = held.frame([{"kind": "late", "start": 0, "late": 4}])
    found = pd.concat(list(windows._first_groups(2)(iter([rows, other, late]))))
    assert sorted(k[0] for k in found[found["kind"] == "row"]["keys"]) == ["c", "e"] and found["late"].sum() == 4


def test_analysis_holds_signatures_as_text():
    """Rows of a window come as texts of signatures, several times for one, and meet the clusters in order of place."""
    import pandas as pd

    def row(name, place, text, n, words=()):
        return {"start": 0, "eventName": name, "signature": text, "path": "p", "block": 0, "ord": place, "line": f"l{place}", "n": n, "words": list(words)}

    held = windows.HeldAnalysis(1000, 1)
    content = held.empty()
    held.add(content, iter([pd.DataFrame([row(None, 9, "request,7,", 2), row("six", 8, None, 3)]), pd.DataFrame([row(None, 3, "request,7,", 4), row(None, 5, "other,5,", 1), row("six", 1, None, 1)])]))
    assert [(r["eventName"], r["value"]) for r in held.rows(content)] == [("six", 4), ("__analysis", 6)]
    assert content["known"]["six"] == (4, "l1") and content["clusters"][0]["line"] == "l3"
