"""Windows of a stream that are held as state: key caps, samples, log analysis, late rows.

What ranks the rows of a window (its first keys, first records, first clusters) needs the
window whole, however its rows are cut into micro-batches. Each task first reduces its
rows to one for each window and group, or for each window and different signature. The reduced rows of a window, or of a part of
its groups, meet its state, which an event-time timer at the window's end closes and turns
into rows. With a key cap a part holds its first groups, and the first of all parts are
the window's. Rows that come after that are counted for their window.

In order of arrival means: by micro-batch, and within one by path and place in the file.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.operators import aggregate as agg
from millrace.operators import patterns
from millrace.plans.task import LogTask

#: Distinct hashes that are kept exactly for a value; beyond it the smallest ones give an estimate.
DISTINCT = 2048
#: Parts of a window that hold its groups, dealt by a hash of the group.
PARTS = 32

PLACE = ["path", "block", "ord"]
#: Order of arrival over all micro-batches.
SEEN = ["batch", *PLACE]


class HeldWindow(StatefulProcessor):
    """A window, or a part of one, as one state value, closed at its end."""

    def __init__(self, interval_ms: int):
        self.interval = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "content binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end = key[0], key[0] + self.interval
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self.frame([{"kind": "late", "start": start, "late": sum(int(table["n"].sum()) for table in rows)}])
            return
        old = self.held.get()
        content = pickle.loads(old[0]) if old else self.empty()
        self.add(content, rows)
        self.held.update((pickle.dumps(content),))
        if not old:
            self.handle.registerTimer(end)
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.held.get()
        self.held.clear()
        yield self.frame([{"kind": "row", "start": key[0], "late": 0, **row} for row in self.rows(pickle.loads(old[0]))] if old else [])

    def frame(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="int64" if c in ("start", "late") else "Int64" if c in ("batch", "block", "ord") else object) for c in self.columns})

    def close(self) -> None:
        pass


class HeldGroups(HeldWindow):
    """Groups of a part of a window: number, total, least and most of each value, distinct hashes, and the first sampled records.

    Rows are added as they come, whatever their order, to the groups that were held or came in
    this micro-batch. With most_keys the first ones by arrival stay after it; later groups
    cannot come before them.
    """

    columns = ("kind", "start", "late", "keys", "vals", "samples", *SEEN)

    def __init__(self, interval_ms: int, kinds: list[str], most_keys: int, most_samples: int):
        super().__init__(interval_ms)
        self.kinds, self.most, self.samples = kinds, most_keys, most_samples

    def empty(self) -> dict:
        return {}

    def add(self, content: dict, rows: Iterator[pd.DataFrame]) -> None:
        full, every = bool(self.most) and len(content) >= self.most, range(len(self.kinds))
        for table in rows:
            for r in table.itertuples(index=False):
                own = content.get(r.keys)
                seen = (r.batch, r.path, r.block, r.ord)
                if own is None:
                    if full:
                        continue
                    own = content[r.keys] = {"seen": seen, "fresh": [], "count": [0.0 for _ in every], "sum": [0.0 for _ in every], "min": [math.inf for _ in every], "max": [-math.inf for _ in every], "sets": [set() for _ in every], "samples": []}
                elif seen < own["seen"]:
                    own["seen"] = seen
                for k in every:
                    own["count"][k] += float(r.counts[k])
                    own["sum"][k] += float(r.sums[k])
                    if r.least[k] < own["min"][k]:
                        own["min"][k] = float(r.least[k])
                    if r.highest[k] > own["max"][k]:
                        own["max"][k] = float(r.highest[k])
                    if self.kinds[k] == "hll":
                        own["sets"][k] = smallest(own["sets"][k] | set(r.sets[k]))
                if self.samples and len(r.samples) and len(own["samples"]) < self.samples:
                    own["fresh"] += [(x["path"], x["block"], x["ord"], list(x["logs"])) for x in r.samples]
                    if len(own["fresh"]) > 2 * self.samples:
                        own["fresh"] = sorted(own["fresh"])[: self.samples]
        if self.most and len(content) > self.most:
            for keys in sorted(content, key=lambda k: content[k]["seen"])[self.most :]:
                del content[keys]
        for own in content.values():
            if own["fresh"]:
                own["samples"] = (own["samples"] + [x[3] for x in sorted(own["fresh"])])[: self.samples]
                own["fresh"] = []

    def value(self, own: dict, k: int) -> float:
        n, kind = own["count"][k], self.kinds[k]
        if kind == "count":
            return float(n)
        if kind == "hll":
            return distinct(own["sets"][k])
        return float({"sum": own["sum"][k], "avg": own["sum"][k] / n, "min": own["min"][k], "max": own["max"][k]}[kind]) if n else 0.0

    def rows(self, content: dict) -> Iterator[dict]:
        for keys, own in content.items():
            yield {"keys": json.loads(keys), "vals": [self.value(own, k) for k in range(len(self.kinds))], "samples": own["samples"], **dict(zip(SEEN, own["seen"], strict=True))}


def _first_groups(most: int):
    """Task that keeps the first `most` groups, by arrival, of the parts of the windows that close."""

    def first_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, kept = 0, 0
        first = lambda: pd.concat(held, ignore_index=True).sort_values(SEEN, kind="stable").groupby("start", sort=False).head(most)
        for pdf in batches:
            grouped = pdf["kind"] == "row"
            yield pdf[~grouped]
            held.append(pdf[grouped])
            size += int(grouped.sum())
            if size > 2 * kept + 10_000:
                held = [first()]
                size = kept = len(held[0])
        if size:
            yield first()

    return first_groups


def smallest(hashes: set[float]) -> set[float]:
    return hashes if len(hashes) <= DISTINCT else set(sorted(hashes)[:DISTINCT])


def distinct(hashes: set[float]) -> float:
    """Number of different hashes, all 64-bit values alike: exact while all are kept, else from how close the smallest ones lie."""
    if len(hashes) < DISTINCT:
        return float(len(hashes))
    return float(round((DISTINCT - 1) / ((max(hashes) + 2.0**63) / 2.0**64)))


def _reduced_groups(kinds: list[str], most_samples: int):
    """Task that reduces rows (start, keys, place, cells, logs) to one for each window and group."""

    def reduce_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values(PLACE, kind="stable")
            cells = pd.DataFrame(np.stack(pdf["cells"].to_numpy()).astype(float) if kinds else np.zeros((len(pdf), 0)), index=pdf.index)
            by = [pdf["start"], pdf["keys"]]
            grouped = cells.groupby(by, sort=False)
            out = pdf.groupby(by, sort=False)[PLACE].first()
            out["n"] = pdf.groupby(by, sort=False).size()
            for name, parts in (("counts", grouped.count()), ("sums", grouped.sum()), ("least", grouped.min()), ("highest", grouped.max())):
                out[name] = list(parts.loc[out.index].to_numpy(float)) if kinds else [[]] * len(out)
            sets = {k: cells[k].groupby(by, sort=False).agg(lambda x: sorted(smallest(set(x.dropna())))) for k, kind in enumerate(kinds) if kind == "hll"}
            out["sets"] = [[sets[k].loc[i] if k in sets else [] for k in range(len(kinds))] for i in out.index]
            logs = pdf[pdf["logs"].notna()] if most_samples else pdf.iloc[:0]
            first: dict[tuple, list] = {}
            for r in logs.itertuples(index=False):
                own = first.setdefault((r.start, r.keys), [])
                if len(own) < most_samples:
                    own.append({"path": r.path, "block": r.block, "ord": r.ord, "logs": list(r.logs)})
            out["samples"] = [first.get(i, []) for i in out.index]
            out = out.reset_index()
            out["batch"] = pdf["batch"].iloc[0]
            yield out

    return reduce_rows


_GROUPS = "batch long, start long, keys string, path string, block long, ord long, n long, counts array<double>, sums array<double>, least array<double>, highest array<double>, sets array<array<double>>, samples array<struct<path:string,block:bigint,ord:bigint,logs:array<string>>>"
_HELD_GROUPS = "kind string, start long, late long, keys array<string>, vals array<double>, samples array<array<string>>, batch long, path string, block long, ord long"


class HeldAnalysis(HeldWindow):
    """Known patterns of a window with count and first line, and clusters of the others with their source words."""

    columns = ("kind", "start", "late", "eventName", "value", "line", "clusters")

    def __init__(self, interval_ms: int, most_patterns: int):
        super().__init__(interval_ms)
        self.most = most_patterns

    def empty(self) -> dict:
        return {"known": {}, "patterns": [], "clusters": []}

    def add(self, content: dict, rows: Iterator[pd.DataFrame]) -> None:
        table = pd.concat(list(rows), ignore_index=True)
        placer, fresh = patterns.Placer(self.most, content["patterns"]), []
        for r in table.sort_values(PLACE, kind="stable").itertuples(index=False):
            if r.eventName is not None:
                count, line = content["known"].get(r.eventName, (0, r.line))
                content["known"][r.eventName] = (count + r.n, line)
                continue
            k, opened = placer.place(patterns.signed(r.signature))
            if k < 0:
                continue
            if opened:
                content["clusters"].append({"count": 0, "line": r.line, "words": {}})
            content["clusters"][k]["count"] += r.n
            fresh += [(w["path"], w["block"], w["ord"], w["word"], w["count"], k) for w in r.words]
        for *_, word, count, k in sorted(fresh):
            words = content["clusters"][k]["words"]
            # A word beyond the cap in this batch was not among the first ones before either.
            if word in words or len(words) <= patterns.MAX_SOURCES:
                words[word] = words.get(word, 0) + count
        content["patterns"] = placer.patterns

    def rows(self, content: dict) -> Iterator[dict]:
        for name, (count, line) in content["known"].items():
            yield {"eventName": name, "value": int(count), "line": line}
        if content["clusters"]:
            listed = [{"cluster": k, "count": int(c["count"]), "sample": c["line"], "sourceWords": [{"source": w, "count": n} for w, n in sorted(c["words"].items())] or None} for k, c in enumerate(content["clusters"])]
            yield {"eventName": "__analysis", "value": sum(c["count"] for c in listed), "clusters": listed}


_ANALYSIS = patterns.distinct_schema("start long, eventName string", "path string, block long, ord long")
_CLUSTERS = "array<struct<cluster:int,count:bigint,sample:string,sourceWords:array<struct<source:string,count:bigint>>>>"


def with_heartbeat(rows: DataFrame, lag: str) -> DataFrame:
    """rows (with ts) and beat: also a row each second whose ts is the clock's time less lag, and beat true.

    The watermark then follows the clock where no data comes, so idle windows close.
    """
    beats = rows.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
    beats = beats.select((F.col("timestamp") - F.expr(f"INTERVAL {lag}")).alias("ts"), F.lit(True).alias("beat"))
    return rows.withColumn("beat", F.lit(False)).unionByName(beats, allowMissingColumns=True)


def marked(front: DataFrame, delay: str, idle: str | None) -> DataFrame:
    """front with its watermark, that of the clock included if idle is given."""
    if idle is None:
        return front.withWatermark("ts", delay)
    # That a filter names ts keeps it after the watermark, which has to see the heartbeats.
    return with_heartbeat(front, idle).withWatermark("ts", delay).filter(~F.col("beat") | F.col("ts").isNull()).drop("beat")


def keep_state(spark: SparkSession) -> None:
    """Held windows and records need the state store that can hold any state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def held_windows(task: LogTask, lines: DataFrame, delay: str, idle: str | None = None) -> DataFrame:
    """Closed windows of a stream, as rows of kind row, and counts of rows that came late, of kind late.

    results() and late() tell them apart. Sets the session's state store (keep_state). idle: let the clock, less this much, close windows while nothing comes.
    """
    keep_state(lines.sparkSession)
    front = marked(task.front(task.records(lines)), delay, idle)
    scope, start = task.scope(front), F.unix_millis("window_start")
    place = [F.coalesce(F.col("path"), F.lit("")).alias("path"), (F.col("block") if "block" in front.columns else F.lit(0)).cast("long").alias("block"), F.col("ord").cast("long").alias("ord")]
    if task.analysing:
        conf = task.group.get("logAnalysis") or {}
        known = patterns.known_pattern(conf.get("patterns") or [], scope)
        rows = patterns.compared(front.select(start.alias("start"), known.alias("eventName"), *place, "line"), conf.get("maxLogLength") or patterns.MAX_LENGTH, F.col("eventName").isNull())
        reduced = rows.select("start", "eventName", *PLACE, "line", "signature", "sources").mapInArrow(patterns.distinct_lines(["start", "eventName"], PLACE), _ANALYSIS)
        held = HeldAnalysis(task.interval_ms, conf.get("maxUnknownPatterns") or patterns.MAX_PATTERNS)
        return reduced.groupBy("start").transformWithStateInPandas(held, f"kind string, start long, late long, eventName string, value long, line string, clusters {_CLUSTERS}", "Append", "EventTime")
    kinds = [v.get("agg") or "count" for v in task.values]
    cells = [agg.cell(v, scope) if k in ("count", "hll") else agg.finite(agg.cell(v, scope)) for v, k in zip(task.values, kinds, strict=True)]
    logs = agg.sampled(front, task.samples, scope) if task.samples else F.lit(None).cast("array<string>")
    keys = F.to_json(F.array(*[F.col(k).cast("string") for k in task.keys])) if task.keys else F.lit("[]")
    # The time of a micro-batch, which stays when the batch runs again, orders arrival over batches.
    batch = F.unix_millis(F.current_timestamp())
    rows = front.select(batch.alias("batch"), start.alias("start"), keys.alias("keys"), *place, F.array(*cells).cast("array<double>").alias("cells"), logs.alias("logs"))
    capped, most = min(task.max_keys, agg.MOST_KEYS) if task.keys else 0, agg.sample_limits(task.samples)[0] if task.samples else 0
    reduced = rows.mapInPandas(_reduced_groups(kinds, most), _GROUPS)
    held = HeldGroups(task.interval_ms, kinds, capped, most)
    closed = reduced.withColumn("part", F.pmod(F.xxhash64("keys"), F.lit(PARTS)).cast("int")).groupBy("start", "part").transformWithStateInPandas(held, _HELD_GROUPS, "Append", "EventTime")
    # All parts of a window close in one micro-batch.
    return (closed.repartition("start").mapInPandas(_first_groups(capped), _HELD_GROUPS) if capped else closed).drop(*SEEN)


def results(task: LogTask, held: DataFrame) -> DataFrame:
    """The rows of closed windows in the columns that the task gives in batch."""
    rows = held.filter("kind = 'row'").withColumn("window_start", F.timestamp_millis("start"))
    if task.analysing:
        listed = F.to_json(F.struct(F.col("clusters").alias("analyzedLogs")))
        analysis = F.when(F.col("eventName") == "__analysis", listed).otherwise(patterns.known_sample())
        return rows.select("window_start", "eventName", "value", analysis.alias("analysis"))
    whole = lambda k: "long" if k in ("count", "hll") else "double"
    values = [F.col("vals")[i].cast(whole(v.get("agg") or "count")).alias(n) for i, (v, n) in enumerate(zip(task.values, agg.value_names(task.values), strict=True))]
    out = [*[F.col("keys")[i].alias(k) for i, k in enumerate(task.keys)], *values]
    if task.samples:
        logs = F.when(F.size("samples") > 0, F.col("samples"))
        out.append(F.when(logs.isNotNull(), agg.samples_json(logs, task.samples, task.scope(rows))).alias("log_samples"))
    return rows.select("window_start", *out)


def late(held: DataFrame) -> DataFrame:
    """window_start, late_rows: rows that came after their window was closed, a row for each micro-batch that had any."""
    return held.filter("kind = 'late'").select(F.timestamp_millis("start").alias("window_start"), F.col("late").alias("late_rows"))


