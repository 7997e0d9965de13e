"""Log tasks over streams of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from millrace.plans.task import LogTask
from millrace.streaming import windows

#: How far event times may be out of order.
OUT_OF_ORDER = "1 second"


def run_stream(task: LogTask, lines: DataFrame, delay: str = OUT_OF_ORDER, first_window=None, idle: str | None = None) -> DataFrame:
    """Results of a stream of lines, for append mode: a window is emitted once the watermark passes it, later rows are dropped.

    Key caps, samples and log analysis are ranked over whole windows, which are held as
    state (needs the RocksDB state store). first_window: windows that start earlier, which
    the stream did not see whole, are left out. idle: an interval; while no data comes, the
    watermark is the clock's time less this, so the last windows close.
    """
    if task.detailed:
        return task.back(task.front(task.records(lines)))
    if task.analysing or task.max_keys or task.samples:
        result = windows.results(task, windows.held_windows(task, lines, delay, idle))
    else:
        front = windows.marked(task.front(task.records(lines)), delay, idle)
        front = front.drop("window_start").withColumn("window_start", F.window("ts", f"{task.interval_ms} milliseconds"))
        result = task.back(front).withColumn("window_start", F.col("window_start")["start"])
    return result.filter(F.col("window_start") >= first_window) if first_window is not None else result


class LateRows(StreamingQueryListener):
    """Counts, by query name, the rows that Spark dropped because they came after their window was closed.

    Add it with spark.streams.addListener before the query starts; it adds up every
    micro-batch. Counts by window are in windows.late().
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
