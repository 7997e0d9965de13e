"""Records of several lines from a stream, by path, with what is pending kept as state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.dialect import plain_groups

SCHEMA = "path string, ord long, line string, lines array<string>"


class LineJoiner(StatefulProcessor):
    """Joins lines that match to the record before them (what=previous) or after them (what=next).

    The last record of a path stays pending until its next head comes or no line has come
    for idle_ms.
    """

    def __init__(self, pattern: str, negate: bool = False, what: str = "previous", max_lines: int = 1024, idle_ms: int = 5000):
        self.pattern, self.negate, self.what, self.cap, self.idle = plain_groups(pattern)[0], negate, what, max(2, max_lines), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "ord long, lines array<string>, cut boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.pending.get()
        first, lines, cut = (old[0], list(old[1]), bool(old[2])) if old else (-1, [], False)
        out, found = [], re.compile(self.pattern).search
        table = pd.concat(list(rows)).sort_values("ord")
        for ord_, line in zip(table["ord"].tolist(), table["line"].tolist(), strict=True):
            matches = bool(found(line)) != self.negate
            if self.what == "previous" and not matches:
                if lines:
                    out.append((first, lines))
                first, lines, cut = ord_, [line], False
            elif self.what == "previous":
                if lines and not cut:
                    lines = [*lines, line]
                    if len(lines) >= self.cap:
                        out.append((first, lines))
                        lines, cut = [], True
            else:
                first, lines = (first, [*lines, line]) if lines else (ord_, [line])
                if not matches or len(lines) >= self.cap:
                    out.append((first, lines))
                    lines = []
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if lines or cut:
            self.pending.update((first, lines, cut))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        else:
            self.pending.clear()
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.pending.get()
        self.pending.clear()
        yield self._frame(key, [(old[0], list(old[1]))] if old and len(old[1]) else [])

    def _frame(self, key, records: list) -> pd.DataFrame:
        return pd.DataFrame({"path": [key[0]] * len(records), "ord": [r[0] for r in records], "line": [r[1][0] for r in records], "lines": [r[1] for r in records]})

    def close(self) -> None:
        pass


def stream_multiline(lines: DataFrame, pattern: str, **options) -> DataFrame:
    """Records (path, ord, line, lines) of a stream of (path, ord, line)."""
    return lines.select("path", "ord", "line").groupBy("path").transformWithStateInPandas(LineJoiner(pattern, **options), SCHEMA, "Append", "ProcessingTime")
