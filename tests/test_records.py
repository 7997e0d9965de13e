"""Records, caps, samples and clusters against plain Python models."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import aggregate, patterns, records
from millrace.functions.expressions import Scope

JOINS = {"not": {"regexp": {"elect": {"type": "line"}, "expression": "^H"}}}


def model(lines, what, cap):
    out, pending, cut = [], [], False
    for line in lines:
        head = line.startswith("H")
        if what == "previous":
            if head:
                if pending:
                    out.append(pending)
                pending, cut = [line], False
            elif pending and not cut:
                pending.append(line)
                if len(pending) >= cap:
                    out.append(pending)
                    pending, cut = [], True
        else:
            pending.append(line)
            if head or len(pending) >= cap:
                out.append(pending)
                pending = []
    return out + ([pending] if pending else [])


@pytest.mark.parametrize("what", ["previous", "next"])
@pytest.mark.parametrize("cap", [2, 3, 1000])
def test_multiline(spark, what, cap):
    rng = random.Random(cap)
    files = {f"f{i}": [rng.choice("Habc") + str(k) for k in range(rng.randint(0, 40))] for i in range(8)}
    rows = [(p, k // 5, k, line) for p, lines in files.items() for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "path string, block long, ord long, line string").repartition(3)
    got = defaultdict(list)
    for r in records.multiline(df, JOINS, what, cap).collect():
        got[r["path"]].append((r["ord"], r["lines"]))
    for path, lines in files.items():
        assert [x for _, x in sorted(got[path])] == model(lines, what, cap), path


def windowed(spark, rows):
    df = spark.createDataFrame(rows, "ord long, w long, k string, line string")
    return df.withColumns({"window_start": F.timestamp_seconds("w"), "lines": F.array("line")})


def test_key_cap_and_samples(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 2), rng.choice("abcdef"), f"line {i} é") for i in range(300)]
    df = windowed(spark, rows)
    first = defaultdict(list)
    for i, w, k, _ in rows:
        if k not in first[w]:
            first[w].append(k)
    want = sorted(i for i, w, k, _ in rows if k in first[w][:3])
    assert sorted(r["ord"] for r in aggregate.first_keys(df, ["k"], 3).collect()) == want
    assert aggregate.first_keys(df, ["k"], 0).count() == 300
    found = aggregate.samples(df, {"maxCount": 2, "maxLength": 6}, ["k"], Scope()).collect()
    assert len(found) == len({(w, k) for _, w, k, _ in rows})
    i = min(i for i, w, k, _ in rows if (w, k) == (0, "a"))
    row = next(r for r in found if r["k"] == "a" and r["window_start"].timestamp() == 0)
    assert f"line {i}"[:6] in row["log_samples"] and row["log_samples"].count("hostname") == 2


@pytest.mark.parametrize("most", [2, 3, 64])
def test_clusters(spark, most):
    rng = random.Random(most)
    words = ["connect", "refused", "timeout reading", "com.acme.Service", "10.0.0.1", "user-17", "payment", "declined", "ok"]
    lines = [(i, 0, "", ":".join(rng.choices(words, k=rng.randint(2, 6)))) for i in range(200)]
    df = windowed(spark, lines)
    got = {r["cluster"]: r["count"] for r in patterns.cluster(df, most_patterns=most).collect()}
    signatures = [[t.asDict() for t in r["s"]] for r in df.orderBy("ord").select(patterns.signature(F.col("line")).alias("s")).collect()]
    assert got == dict(patterns.place_in_order(signatures, most))


def test_tokens(spark):
    line = "2022-02-03 08:07:09,123 ERROR [main] fail: connect->10.0.0.1, com.acme.Foo - bad things happened"
    row = spark.createDataFrame([(line,)], "line string").select(patterns.signature(F.col("line")).alias("s")).first()["s"]
    assert [t["word"] for t in row] == ["ERROR", "main", "fail", "connect", "10.0.0.1", "com.acme.Foo", "bad things happened"]
    assert [t["source"] for t in row] == [False, False, False, False, True, True, False]
    assert [t["important"] for t in row] == [False] * 6 + [True]


def test_source_words_of_clusters(spark):
    lines = [(k, "2024-01-01", f"request failed,host{k % 3}.com,giving up") for k in range(9)] + [(9, "2024-01-01", "disk nearly full today")]
    df = spark.createDataFrame(lines, "ord long, window_start string, line string")
    found = patterns.analyse(df, {}, None).collect()
    assert [(r["eventName"], r["value"]) for r in found] == [("__analysis", 10)]
    logs = json.loads(found[0]["analysis"])["analyzedLogs"]
    assert [x["count"] for x in logs] == [9, 1]
    assert logs[0]["sourceWords"] == [{"source": f"host{k}.com", "count": 3} for k in range(3)]
    assert "sourceWords" not in logs[1]
    whole = spark.createDataFrame([(0, "a", f"host{k}.com") for k in range(70)], "ord long, g string, line string")
    assert patterns.source_words(whole, ["g"]).count() == 61


def test_lines_are_reduced_in_their_task(spark, monkeypatch):
    """A task passes on its different signatures, not its lines; what it holds is bounded, and nothing is lost by passing on early."""
    texts = ["request failed,host1.com,giving up", "disk nearly full today", "", "request failed,host2.com,giving up"]
    lines = [(k, 0, "", texts[k % 4]) for k in reversed(range(2000))]
    df = windowed(spark, lines).repartition(2)
    reduced = patterns._signed(df, "window_start", 300).collect()
    # Both hosts are source words of one size, so their lines have one signature.
    assert len(reduced) <= 2 * 3 and sum(r["count"] for r in reduced) == 2000
    first = {r["signature"]: r for r in sorted(reduced, key=lambda r: r["seen_at"], reverse=True)}
    assert {r["seen_at"]["ord"]: r["line"] for r in first.values()} == dict(enumerate(texts[:3]))
    words = [(w["word"], w["count"], w["ord"]) for r in reduced for w in r["words"]]
    assert {w: sum(n for x, n, _ in words if x == w) for w, *_ in words} == {"host1.com": 500, "host2.com": 500}
    assert min(words, key=lambda w: w[2])[::2] == ("host1.com", 0)
    row = df.select(patterns.signature(F.col("line")).alias("s"), patterns.signature_text(patterns.signature(F.col("line"))).alias("t")).distinct().collect()
    for r in row:
        assert patterns.signed(r["t"]) == [{k: v for k, v in t.asDict().items() if k != "word"} for t in r["s"]]
    import pyarrow as pa

    monkeypatch.setattr(patterns, "HELD_LINES", 2)
    batches = [pa.RecordBatch.from_pylist([{"w": 1, "ord": 10 * b + k, "line": f"l{10 * b + k}", "signature": f"a{k},2,", "sources": []} for k in range(3)], pa.schema([("w", pa.int64()), ("ord", pa.int64()), ("line", pa.string()), ("signature", pa.string()), ("sources", pa.list_(pa.string()))])) for b in range(3)]
    out = [b.num_rows for b in patterns.distinct_lines(["w"], ["ord"])(iter(batches))]
    assert out == [3, 3, 3]
