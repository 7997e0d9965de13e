"""Maximal repeats with all their occurrences, by intervals of common prefixes on both sides of anchors.

Every string of LENGTH bytes that occurs twice belongs to one group: the longest string
that holds it wherever it occurs. Groups are maximal repeats: their occurrences differ in
the byte before and in the byte after, or end with a text.

1. Contexts of repeated anchors are classed by their bytes; a class is scanned once, its
   occurrences stay where they are.
2. The suffixes of a K-gram form an interval tree; the left sides of each interval's
   members form another. A node of both is a set of classes that share its string: it is
   right-diverse by the first tree, left-diverse by the second.
3. The strings of one anchor end where the next anchor's begin. Two groups are one where
   each occurrence of either stands beside one of the other, which three counts tell.

K-grams with more than HOT contexts are split by longer shared bytes, as for the removal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import durable, joined_back, texts
from millrace.llm.repeat_intervals import BUCKET_BYTES, HOT, LENGTH, LEVELS, NO_ID, anchors, answer, ask, common, home, intervals, sized, tasks_for

SENT = "kind int, bucket long, hash long, cls binary, times long, place long, key long, anchor long, delta long, bytes binary"
GROUPS = "cls binary, low int, high int, gid binary"


def nodes(strings: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
    """(depth, depth of the parent, members) of the interval tree of some strings, leaves too."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    lcp = [-1] * (len(order) + 1)
    for at in range(1, len(order), 4096):
        some = order[at - 1 : at + 4096]
        lcp[at : at + len(some) - 1] = common([strings[i] for i in some[:-1]], [strings[i] for i in some[1:]]).tolist()
    deepest: dict[tuple[int, int], int] = {}
    for depth, a, b in intervals(np.array(lcp[:-1])):
        if a < b:
            deepest[a, b] = max(depth, deepest.get((a, b), 0))
    for (a, b), depth in deepest.items():
        yield depth, max(lcp[a], lcp[b + 1]), order[a : b + 1]
    for i, member in enumerate(order):
        yield len(strings[member]), max(lcp[i], lcp[i + 1]), [member]


def closed(left: list[bytes], right: list[bytes], n: list[int]) -> Iterator[tuple[list[int], int, int]]:
    """(members, low, high): strings that start low to high bytes before an anchor and occur for just these members, twice or more.

    left: reversed bytes before the anchors; right: bytes from them on; n: occurrences of each member.
    """
    for r, above, some in nodes(right):
        first, last = max(0, LENGTH - r), LENGTH - 1 - above
        if first > last or sum(n[i] for i in some) < 2:
            continue
        for l, beside, part in nodes([left[i] for i in some]):
            low, high = max(first, beside + 1), min(last, l)
            members = [some[i] for i in part]
            if low <= high and sum(n[i] for i in members) > 1:
                yield members, low, high


def scan(group: pd.DataFrame) -> pd.DataFrame:
    """Rows of GROUPS: for each class of a bucket, its strings by the groups that they belong to."""
    out = []
    for _, part in group.groupby("hash"):
        part = part.groupby(["cls", "delta", "bytes"], as_index=False, sort=False)["times"].sum()
        cls, n = part["cls"].to_list(), part["times"].to_list()
        left = [x[:d][::-1] for x, d in zip(part["bytes"], part["delta"], strict=True)]
        right = [x[d:] for x, d in zip(part["bytes"], part["delta"], strict=True)]
        for members, low, high in closed(left, right, n):
            one = members[0]
            gid = xxhash.xxh128_digest(left[one][:high][::-1] + right[one][: LENGTH - low])
            out += [(cls[i], low, high, gid) for i in members]
    return pd.DataFrame(out, columns=["cls", "low", "high", "gid"])


def classed(place: np.ndarray, key: np.ndarray, raws: list[bytes], known: list[np.ndarray], buckets: int) -> Iterator[tuple]:
    """Rows of SENT: the classes of contexts of some texts (kind 0), with counts, and their occurrences (kind 1)."""
    seen: dict[tuple, list] = {}
    for h, text, at, first, last in anchors(raws):
        for t in np.unique(text).tolist():
            own = np.nonzero(text == t)[0]
            own = own[np.isin(at[own], known[t])]
            for i, f, s, x in zip(at[own].tolist(), first[own].tolist(), last[own].tolist(), h[own].view(np.int64).tolist(), strict=True):
                context = raws[t][f : s + LENGTH]
                one = seen.setdefault((x, i - f, context), [xxhash.xxh128_digest(context, seed=i - f), 0])
                one[1] += 1
                yield 1, 0, x, one[0], 1, int(place[t]), int(key[t]), i, 0, b""
    for (x, delta, context), (cls, n) in seen.items():
        yield 0, x % buckets, x, cls, n, 0, 0, 0, delta, context


def arrow(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def scanned(parts: DataFrame, tasks: int) -> DataFrame:
    return parts.select("bucket", "hash", "cls", "times", "delta", "bytes").repartition(tasks, "bucket").groupBy("bucket").applyInPandas(scan, GROUPS)


def cut(parts: DataFrame, width: int, buckets: int) -> DataFrame:
    """Classes cut into the ranges of a split; a piece's hash is that of the bytes which all strings of its range share."""
    schema = arrow_schema(SENT)

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple]:
        for cls, n, delta, data in zip(*(batch.column(c).to_pylist() for c in ("cls", "times", "delta", "bytes")), strict=True):
            least = delta - (len(data) - LENGTH)
            for a in range(least // width * width, delta + 1, width):
                top, bottom = min(a + width - 1, delta), max(a, least)
                shared = xxhash.xxh64_intdigest(data[delta - a : delta - (a + width - 1) + LENGTH], seed=a)
                shared -= (shared >> 63) << 64
                yield 0, shared % buckets, shared, cls, n, 0, 0, 0, top, data[delta - top : delta - bottom + LENGTH]

    return parts.mapInArrow(lambda batches: (x for batch in batches for x in arrow(pieces(batch), schema)), SENT)


def class_groups(contexts: DataFrame, most: int, buckets: int, tasks: int) -> DataFrame:
    """Rows of GROUPS for the classes of contexts, by parts of at most `most` rows."""
    parts = sized(contexts, most)
    found = scanned(parts.filter("not large"), tasks)
    for width in LEVELS:
        parts = parts.filter("large")
        if parts.isEmpty():
            return found
        parts = durable(cut(parts, width, buckets))
        if width > 1:
            parts = sized(parts, most)
            found = found.unionByName(scanned(parts.filter("not large"), tasks))
    # Parts of one string: its members are a group if it occurs twice.
    counts = parts.groupBy("bytes").agg(F.count(F.lit(1)).alias("rows"), F.sum("times").alias("all"))
    strings = joined_back(parts.select("cls", "delta", "bytes"), counts.filter(F.col("all") > 1), ["bytes"], "rows", parts.count())
    depth = F.col("delta").cast("int")
    return found.unionByName(strings.select("cls", depth.alias("low"), depth.alias("high"), F.unhex(F.substring(F.sha2("bytes", 256), 1, 32)).alias("gid")))


def maximal_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """group_id (string), length, copies, doc_id, start: one row for each occurrence of each group.

    A group is a string of `length` bytes that occurs `copies` times, as the module says; start is its place in the text's UTF-8
    bytes. Texts are whole; repeats never cross them. A null text is empty. Rows with equal doc_id and text are one text; rows that
    share a doc_id only, or have none, are texts of their own. Occurrences may overlap. Tables without a repeat, and empty ones,
    give no rows. Other columns are ignored.
    """
    docs = texts(docs).dropDuplicates(["doc_id", "text"])
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("place"), F.xxhash64("text", F.col("doc_id").isNull()).alias("key"), "doc_id", "text").withColumn("home", home("place"))
    docs = durable(docs)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, tasks = max(128, total // BUCKET_BYTES), tasks_for(docs, total)
    asked_schema = pa.schema([("bucket", pa.int64()), ("settled", pa.bool_()), *((c, pa.binary()) for c in ("hash", "n", "homes", "at"))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from arrow(iter(ask(batch.column("home").to_numpy(), [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()], buckets)), asked_schema)

    asked = docs.mapInArrow(find, "bucket long, settled boolean, hash binary, n binary, homes binary, at binary")
    answers = asked.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(lambda g: answer(g, hot), "home long, known long, is_hot boolean")
    of_doc = answers.filter("not is_hot").groupBy("home").agg(F.collect_set("known").alias("known"))
    schema = arrow_schema(SENT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            known = [np.array(k, np.int64) for k in batch.column("known").to_pylist()]
            yield from arrow(classed(batch.column("place").to_numpy(), batch.column("key").to_numpy(), raws, known, buckets), schema)

    sent = durable(docs.join(of_doc, "home").select("place", "key", "text", "known").mapInArrow(send, SENT))
    contexts = sent.filter("kind = 0")
    found = class_groups(contexts, hot, buckets, tasks)
    classes = found.groupBy("cls").agg(F.collect_set(F.struct("low", "high", "gid")).alias("parts"))
    classes = classes.join(contexts.groupBy("cls").agg(F.sum("times").alias("n")), "cls")
    places = sent.filter("kind = 1").select("cls", "place", "key", "anchor")
    total_places = places.count()
    runs = joined_back(places, classes, ["cls"], "n", total_places).select("place", "key", "anchor", F.explode("parts").alias("part"))
    runs = runs.select("place", "key", F.col("part.gid").alias("gid"), (F.col("anchor") - F.col("part.high")).alias("start"), (F.col("anchor") - F.col("part.low")).alias("last"))
    own = Window.partitionBy("place", "key").orderBy("start")
    beside = F.lead(F.struct("start", "gid")).over(own)
    runs = durable(runs.withColumn("beside", beside).withColumn("next_gid", F.when(F.col("beside.start") == F.col("last") + 1, F.col("beside.gid"))).drop("beside"))
    sizes = runs.groupBy("gid").agg(F.count(F.lit(1)).alias("copies"))
    pairs = runs.filter("next_gid is not null").groupBy("gid", "next_gid").agg(F.count(F.lit(1)).alias("pairs"))
    pairs = pairs.join(sizes, "gid").filter("pairs = copies").drop("copies").join(sizes.withColumnRenamed("gid", "next_gid"), "next_gid").filter("pairs = copies")
    flags = sizes.join(pairs.select("gid", F.lit(True).alias("goes_on")), "gid", "left")
    runs = joined_back(runs.drop("next_gid"), flags, ["gid"], "copies", runs.count())
    runs = runs.withColumn("begins", F.lag(F.coalesce("goes_on", F.lit(False)), 1, False).over(own) == F.lit(False))
    runs = runs.withColumn("run", F.sum(F.col("begins").cast("long")).over(own))
    whole = runs.groupBy("place", "key", "run").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.max("copies").alias("copies"), F.min_by("gid", "start").alias("gid"))
    ids = docs.select("place", "key", "doc_id")
    return whole.join(ids, ["place", "key"]).select(F.lower(F.hex("gid")).alias("group_id"), (F.col("last") - F.col("start") + LENGTH).alias("length"), "copies", "doc_id", "start")
