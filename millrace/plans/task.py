"""A declarative log task compiled to one DataFrame plan, for batch and streaming.

Order of the stages: pre-parse condition, parser, variables, time, condition, keys, then
the back half: log analysis, detail rows, or windowed aggregates with key cap and samples.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import expressions, timestamps
from millrace.functions.expressions import Scope, keeps, predicate
from millrace.operators import aggregate as agg
from millrace.operators import parsers, patterns, quality, records

#: Lines that show which time layout most lines of a task have.
LAYOUT_SAMPLE = 200


@dataclass
class LogTask:
    """A task in the shape of its JSON: select, from, where, groupBy, window, output."""

    conf: dict
    meta: dict[str, Column] = field(default_factory=dict)
    now: Column | None = None

    @classmethod
    def from_json(cls, text: str, **more) -> LogTask:
        return cls(json.loads(text), **more)

    @property
    def log(self) -> dict:
        return (self.conf.get("from") or {}).get("log") or {}

    @property
    def values(self) -> list[dict]:
        return (self.conf.get("select") or {}).get("values") or []

    @property
    def group(self) -> dict:
        return self.conf.get("groupBy") or {}

    @property
    def groups(self) -> list[dict]:
        return self.group.get("groups") or []

    @property
    def keys(self) -> list[str]:
        return [g["name"] for g in self.groups]

    @property
    def interval_ms(self) -> int:
        return agg.interval_ms((self.conf.get("window") or {}).get("interval", 60_000))

    @property
    def analysing(self) -> bool:
        return any(v.get("agg") == "loganalysis" for v in self.values)

    @property
    def detailed(self) -> bool:
        return bool((self.group.get("details") or {}).get("enabled"))

    @property
    def max_keys(self) -> int:
        return self.group.get("maxKeySize") or 0

    @property
    def samples(self) -> dict:
        """Configuration of the log samples, empty if there are to be none."""
        wanted = (self.conf.get("select") or {}).get("logSamples") or {}
        return wanted if wanted.get("enabled") else {}

    def records(self, lines: DataFrame) -> DataFrame:
        """Lines (path, block, ord, line) as records."""
        multi = self.log.get("multiline") or {}
        if multi.get("enabled"):
            return records.multiline(lines, multi.get("where"), multi.get("what") or "previous", multi.get("maxLines") or 0)
        return records.single_lines(lines)

    def scope(self, df: DataFrame) -> Scope:
        json_column = F.col("column_json") if "column_json" in df.columns else None
        tags = {c: F.col(c) if c in df.columns else F.create_map().cast("map<string,string>") for c in ("log_tags", "path_tags")}
        scope = Scope(column_json=json_column, meta=self.meta, **tags)
        for var in (self.log.get("vars") or {}).get("vars") or []:
            scope = replace(scope, variables=scope.variables | {var["name"]: F.col(f"var_{var['name']}")})
        return scope

    def _variables(self, df: DataFrame, scope: Scope) -> tuple[DataFrame, Column]:
        ready = F.lit(True)
        for var in (self.log.get("vars") or {}).get("vars") or []:
            name = f"var_{var['name']}"
            df = df.withColumn(name, expressions.text(var.get("elect"), scope))
            ready = ready & F.col(name).isNotNull()
        return df, ready

    def seen(self, rows: DataFrame) -> timestamps.Seen | None:
        """The time layouts to try first, from LAYOUT_SAMPLE lines; None where nothing needs detecting or rows are a stream. A line that has none of them is read in any layout."""
        conf = self.log.get("time") or {}
        if (conf.get("type") or "auto") != "auto" or rows.isStreaming:
            return None
        return timestamps.seen_in([r["line"] for r in rows.select("line").filter("line <> ''").limit(LAYOUT_SAMPLE).collect()])

    def _time(self, df: DataFrame, scope: Scope, rows: DataFrame) -> DataFrame:
        """df with ts; rows: the lines whose layouts count."""
        return agg.once(df, "ts", timestamps.event_time(self.log.get("time"), scope, now=self.now, seen=self.seen(rows)))

    def _condition(self, scope: Scope) -> tuple[Column, Scope]:
        return predicate(self.conf.get("where"), scope)

    def front(self, rows: DataFrame) -> DataFrame:
        """Records with ts, window_start and the key columns; rows that fail a stage are gone."""
        df = parsers.before_parsing(rows, (self.log.get("parse") or {}).get("where"))
        if self.analysing:
            df = self._time(df, self.scope(df), rows).filter(timestamps.usable(F.col("ts")))
            return df.withColumn("window_start", agg.window_start(F.col("ts"), self.interval_ms))
        df = parsers.parse(df, self.log.get("parse"))
        scope = self.scope(df)
        df, ready = self._variables(df, scope)
        df = self._time(df.filter(ready), scope, rows).filter(timestamps.usable(F.col("ts")))
        condition, after = self._condition(scope)
        df = df.filter(F.coalesce(condition, F.lit(False)))
        if after is not scope:
            df = df.withColumn("columns", after.columns)
        df = df.withColumns({g["name"]: expressions.text(g.get("elect"), scope) for g in self.groups})
        for key in self.keys:
            df = df.filter(F.col(key).isNotNull())
        return df.withColumn("window_start", agg.window_start(F.col("ts"), self.interval_ms))

    def back(self, df: DataFrame) -> DataFrame:
        scope = self.scope(df)
        if self.analysing:
            return patterns.analyse(df, self.group.get("logAnalysis") or {}, scope)
        if self.detailed:
            return self.details(df, scope)
        result = agg.aggregate(df, self.values, self.keys, scope, most_keys=self.max_keys)
        if self.samples:
            extra = agg.samples(df, self.samples, self.keys, scope)
            result = result.join(extra, ["window_start", *self.keys], "left")
        return result

    def details(self, df: DataFrame, scope: Scope) -> DataFrame:
        """One row for each record: ts, keys and values; count is 1, numbers that fail are 0."""

        counted = lambda v: (v.get("agg") or "count") == "count"
        numbers = [F.lit(1.0) if counted(v) else expressions.numeric(v.get("elect"), scope) for v in self.values]
        df = agg.once(df, "cells", F.struct(*[n.alias(f"c{i}") for i, n in enumerate(numbers)]))
        return df.select("ts", *self.keys, *[F.coalesce(agg.finite(F.col("cells")[f"c{i}"]), F.lit(0.0)).alias(v["as"]) for i, v in enumerate(self.values)])

    def run(self, lines: DataFrame) -> DataFrame:
        """Lines to results."""
        return self.back(self.front(self.records(lines)))

    def staged(self, lines: DataFrame, emitted_before: Column | None = None) -> DataFrame:
        """Every line or record with the stage in which it ends, and its window if it has a time.

        emitted_before: windows that start earlier have been emitted; their rows are late.
        Nothing is dropped on the way, so rows are read once; only a cap on keys joins
        the keys that are kept.
        """
        multi = (self.log.get("multiline") or {}).get("enabled")
        rows = self.records(lines) if multi else lines.withColumn("lines", F.array("line"))
        tests = [] if multi else [("broken", ~records.broken(F.col("line"))), ("ignored", ~records.noise(F.col("line")))]
        tests.append(("pre_where", keeps((self.log.get("parse") or {}).get("where"), Scope(line=F.array_join("lines", "\n")))))
        parsed, fits = parsers.parsed_and_fits(rows, self.log.get("parse"))
        tests.append(("parse", F.lit(True) if fits is None else fits))
        scope = self.scope(parsed)
        parsed, ready = self._variables(parsed, scope)
        parsed = self._time(parsed, scope, rows)
        condition, _ = self._condition(scope)
        parsed = parsed.withColumns({f"key_{g['name']}": expressions.text(g.get("elect"), scope) for g in self.groups})
        keys = [f"key_{k}" for k in self.keys]
        keyed = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
        tests += [("vars", ready), ("time", timestamps.usable(F.col("ts"))), ("where", condition), ("group", keyed)]
        parsed = parsed.withColumn("window_start", agg.window_start(F.col("ts"), self.interval_ms))
        if emitted_before is not None:
            tests.append(("late", F.col("window_start") >= emitted_before))
        cells = [agg.cell(v, scope) for v in self.values if v.get("agg") != "loganalysis"]
        selected = F.greatest(*[c.isNotNull() for c in cells]) if len(cells) > 1 else cells[0].isNotNull() if cells else F.lit(True)
        reached = quality.stage_of(tests)
        last = F.when((reached == "processed") & ~selected, "select").otherwise(reached)
        timed = F.when(F.col("reached").isin("broken", "ignored", "pre_where", "parse"), None).otherwise(F.col("window_start"))
        place = [c for c in ("file_time", "path", "block", "ord") if c in parsed.columns]
        parsed = parsed.select(*place, "line", *keys, "window_start", F.struct(reached.alias("reached"), last.alias("last")).alias("x")).select(*place, "line", *keys, "window_start", "x.*")
        limit = self.max_keys
        stage = F.col("last")
        if limit > 0 and keys:
            by = ["window_start", *keys]
            kept = agg.kept_keys(parsed.filter(F.col("reached") == "processed"), keys, limit).select(*[F.col(c).alias(f"kept_{c}") for c in by], F.lit(True).alias("kept"))
            parsed = parsed.join(kept, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"kept_{c}")), by, F.lit(True)), "left")
            stage = F.when((F.col("reached") == "processed") & F.col("kept").isNull(), "keys_cap").otherwise(stage)
        return parsed.select("path", "ord", "line", stage.alias("stage"), timed.alias("window_start"))

    def explain(self, lines: DataFrame) -> DataFrame:
        """path, ord, line, stage, conditions (each node of the condition by its path), keys and values of every record."""
        rows = parsers.parse(self.records(lines), self.log.get("parse"))
        scope = self.scope(rows)
        rows, ready = self._variables(rows, scope)
        rows = self._time(rows, scope, rows)
        nodes = [F.struct(F.lit(p).alias("node"), predicate(w, scope)[0].alias("result")) for p, w in condition_nodes(self.conf.get("where"))]
        keys = F.map_from_arrays(F.array(*map(F.lit, self.keys)), F.array(*[expressions.text(g.get("elect"), scope) for g in self.groups])) if self.groups else F.create_map().cast("map<string,string>")
        values = [(v["as"], F.lit(1.0) if (v.get("agg") or "count") == "count" else expressions.numeric(v.get("elect"), scope)) for v in self.values if v.get("agg") != "loganalysis"]
        numbers = F.map_from_arrays(F.array(*[F.lit(n) for n, _ in values]), F.array(*[x for _, x in values])) if values else F.create_map().cast("map<string,double>")
        stage = quality.stage_of([("vars", ready), ("time", timestamps.usable(F.col("ts"))), ("where", predicate(self.conf.get("where"), scope)[0])])
        tree = F.array(*nodes) if nodes else F.array().cast("array<struct<node:string,result:boolean>>")
        return rows.select("path", "ord", "line", stage.alias("stage"), tree.alias("conditions"), keys.alias("keys"), numbers.alias("values"))


def condition_nodes(where: dict | None, path: str = "") -> list[tuple[str, dict]]:
    """Every node of a condition with its path, parents first."""
    out = []
    for kind, own in (where or {}).items():
        here = f"{path}/{kind}"
        out.append((here, {kind: own}))
        if kind in ("and", "or"):
            for i, part in enumerate(own):
                out += condition_nodes(part, f"{here}[{i}]")
        elif kind == "not":
            out += condition_nodes(own, here)
    return out
