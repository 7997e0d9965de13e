"""Lines of files that are appended to, as a stream.

Spark's file stream reads a file once. Here the offset of a stream holds, for each file,
how many of its bytes have been read, up to the last line end; what follows the last line
end waits. A file is known by its device and inode, so one that is renamed is not read
again, and one that is replaced or cut short is read from its start.

The files have to be seen by driver and executors at the same paths, such as log volumes
that all of them mount. A range of a file is read in splits, and a line belongs to the split in
which it starts. A task reads several splits where a micro-batch has many more than tasks.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from millrace.sources.logs import checked_glob, shaped

SCHEMA = "path string, block long, ord long, value string"
SPLIT_BYTES, READ_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 10_000
#: A task reads one split in so many of a micro-batch, and up to SPLIT_BYTES, unless a split is larger.
TASKS = 64


class Split:
    def __init__(self, path: str, identity: str, pattern: str, first: int, stop: int, begins: int):
        self.path, self.identity, self.pattern, self.first, self.stop, self.begins = path, identity, pattern, first, stop, begins


class Splits(InputPartition):
    """The splits that one task reads, in order."""

    def __init__(self, splits: list[Split]):
        self.splits = splits


def dealt(splits: list[Split]) -> list[Splits]:
    """All splits, as few tasks as the bytes of a task allow."""
    most = min(SPLIT_BYTES, -(-sum(s.stop - s.first for s in splits) // TASKS))
    out, size = [Splits([])], 0
    for s in splits:
        if out[-1].splits and size + s.stop - s.first > most:
            out.append(Splits([]))
            size = 0
        out[-1].splits.append(s)
        size += s.stop - s.first
    return out


def identity(path: str) -> tuple[str, int] | None:
    """(device and inode, size) of a file; None if it has gone."""
    try:
        found = os.stat(path)
    except FileNotFoundError:
        return None
    return f"{found.st_dev}:{found.st_ino}", found.st_size


def last_line_end(path: str, least: int, size: int) -> int:
    """Position behind the last line end in the bytes least to size, least if there is none."""
    with open(path, "rb") as file:
        stop = size
        while stop > least:
            start = max(least, stop - READ_BYTES)
            file.seek(start)
            if (at := file.read(stop - start).rfind(b"\n")) >= 0:
                return start + at + 1
            stop = start
    return least


class GrowingReader(DataSourceStreamReader):
    """Offsets are {"files": {identity: [path, bytes read, generation]}}."""

    def __init__(self, options: dict):
        self.pattern = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.known: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        files = {}
        for path in sorted(p for p in glob.glob(self.pattern) if os.path.isfile(p)):
            found = identity(path)
            if found is None:
                continue
            key, size = found
            _, read, generation = self.known.get(key, [path, 0, 0])
            if size < read:
                read, generation = 0, generation + 1
            files[key] = [path, last_line_end(path, read, size), generation]
        self.known = self.known | files
        return {"files": files}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before = start["files"]
        self.known = end["files"] | {k: v for k, v in self.known.items() if k not in end["files"] or v[2] > end["files"][k][2] or (v[2] == end["files"][k][2] and v[1] > end["files"][k][1])}
        out = []
        for key, (path, stop, generation) in sorted(end["files"].items(), key=lambda x: x[1]):
            _, read, old = before.get(key, [path, 0, generation])
            first = read if old == generation else 0
            out += [Split(path, key, self.pattern, at, min(at + self.split, stop), first) for at in range(first, stop, self.split)]
        return dealt(out)

    def read(self, partition: Splits) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str]] = []
        path = None
        for split in partition.splits:
            if rows and split.path != path:
                yield _batch(path, rows)
                rows = []
            path = split.path
            for row in self.lines(split):
                rows.append(row)
                if len(rows) == BATCH_ROWS:
                    yield _batch(path, rows)
                    rows = []
        if rows:
            yield _batch(path, rows)

    def lines(self, split: Split) -> Iterator[tuple[int, str]]:
        """(position, text) of the lines that start in a split."""
        path = split.path
        if (found := identity(path)) is None or found[0] != split.identity:
            # Renamed since the offset was taken.
            path = next((p for p in glob.glob(os.path.join(os.path.dirname(path), "*")) if (identity(p) or ("", 0))[0] == split.identity), None)
            if path is None:
                raise FileNotFoundError(f"{split.path} went before it was read")
        with open(path, "rb") as file:
            at = split.first
            if at > split.begins:
                # The line that the split before has begun is that split's.
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            while at < split.stop and (raw := file.readline()):
                yield at, raw.removesuffix(b"\n").decode("utf-8", "replace")
                at += len(raw)

    def commit(self, end: dict) -> None:
        pass


def _batch(path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    n = len(rows)
    columns = [pa.array([path] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["path", "block", "ord", "value"])


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options)


def stream_growing_lines(spark: SparkSession, pattern: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines of the files that fit a path or glob as they are written: each once, ord the byte at which it starts.

    Bytes that are not UTF-8 become replacement characters. A file that goes before its
    last lines were read stops the stream; a glob that takes in rotated names avoids it.
    """
    spark.dataSource.register(GrowingFiles)
    read = spark.readStream.format("growing_files").option("path", checked_glob(pattern)).option("splitBytes", split_bytes).load()
    return shaped(read.select("path", "block", "ord", F.col("value").alias("line")))
