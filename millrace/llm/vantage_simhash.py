"""SimHash near-duplicates through vantage-point trees.

Texts become 64-bit fingerprints where they are read; equal fingerprints are one
point from then on. A vantage-point tree over a bounded sample splits the points into
shards by their Hamming distance from vantage points. A point belongs to one shard and
visits those whose half it may reach by the triangle bound: inside if d <= mu + r,
outside if d > mu - r. Every pair within r thus meets in a shard whatever the sample
was. Each shard builds a tree of its own points, searches it for its own points and
the visitors with the same bounds, and returns links to the smallest point of each
component it sees, never pairs. Components over all shards come from large-star and
small-star steps in DataFrame joins.

Distances of unrelated fingerprints crowd around 32, so about 0.73 of all points reach
both halves at a split: work grows as the number of different fingerprints to the
power 1.8. That is this method's limit at r = 4, not one of memory or of a single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import durable, joined_back, texts, without

SHINGLE = 4
RADIUS = 4
SHARD_POINTS = 4096
#: Bound on the fingerprints that the driver sees to place vantage points.
SAMPLE = 8192
LEAF = 256
QUERY_BLOCK = 8192


def fingerprint(text: str) -> int:
    """64 bits: 1 where over half of the hashed shingles have 1; no words: 0."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], stops[at : at + (1 << 15)], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text and others) with fp, the fingerprint as a signed long, in place of text."""
    other = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in other]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(make, StructType(other).add("fp", "long"))


class VantageTree:
    """Nodes (vantage, mu, inside, outside); a leaf is a number. Points at mu or nearer are inside."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.members: list[np.ndarray] = []
        self.root = self._build(points, np.arange(len(points)), leaf)

    def _build(self, points: np.ndarray, own: np.ndarray, leaf: int):
        if len(own) > leaf:
            vantage = points[own[len(own) // 2]]
            d = np.bitwise_count(points[own] ^ vantage)
            mu = int(np.median(d))
            near = d <= mu
            if near.all():  # ties at the median
                mu = int(d.max()) - 1
                near = d <= mu
            if near.any() and not near.all():
                return vantage, mu, self._build(points, own[near], leaf), self._build(points, own[~near], leaf)
        self.members.append(own)
        return len(self.members) - 1

    def visits(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, positions of the queries that may have a neighbour there)."""
        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, int):
                yield node, at
                continue
            vantage, mu, inside, outside = node
            d = np.bitwise_count(queries[at] ^ vantage).astype(np.int16)
            stack += [(side, at[go]) for side, go in ((inside, d <= mu + radius), (outside, d > mu - radius)) if go.any()]


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Adds links a-b to parent, where each entry points at the smallest of its component."""
    while len(a):
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(parent, high[apart], low[apart])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def shard_links(own: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, smallest point of its component) among own points and visitors of a shard."""
    points = np.concatenate([own, visitors])
    parent = np.arange(len(points))
    tree = VantageTree(own, LEAF)
    for start in range(0, len(points), QUERY_BLOCK):
        for leaf, at in tree.visits(points[start : start + QUERY_BLOCK], radius):
            members = tree.members[leaf]
            for some in range(0, len(at), 1024):
                q = start + at[some : some + 1024]
                hit, member = np.nonzero(np.bitwise_count(points[q][:, None] ^ own[members][None, :]) <= radius)
                unite(parent, q[hit], members[member])
    linked = np.nonzero(parent != np.arange(len(points)))[0]
    return points[linked], points[parent[linked]]


def near_links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(a, b): links that connect all fp of points (fp: different longs) that are radius or less apart, in one way or by steps."""
    total = points.count()
    sample = points.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    shards = max(1, -(-total // shard_points))
    tree = VantageTree(sample, max(1, len(sample) // shards))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            home = np.zeros(len(fp), np.int64)
            for leaf, at in tree.visits(fp, 0):
                home[at] = leaf
            rows = []
            for leaf, at in tree.visits(fp, radius):
                # A pair whose points have different homes meets in the later one.
                rows.append((leaf, fp[at[home[at] == leaf]].tobytes(), fp[at[home[at] < leaf]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["shard", "own", "visitors"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        own, visitors = (np.frombuffer(b"".join(group[c]), np.uint64) for c in ("own", "visitors"))
        a, b = shard_links(own, visitors, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = points.select("fp").mapInArrow(route, "shard long, own binary, visitors binary")
    return routed.groupBy("shard").applyInPandas(search, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in links (a, b), root being the smallest node of its component; roots have no row.

    Large-star and small-star steps until nothing changes; each round is kept in the
    checkpoint folder, and the number of rounds grows with the logarithm of the size.
    """
    edges = durable(links.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("root", "node")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(least, "node")
        edges = durable(small.select("node", F.col("m").alias("root")).union(small.filter("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == before:
            return edges
        before = now


def placed(found: DataFrame, radius: int) -> DataFrame:
    """found (doc_id, fp and others) with the component_id of each row."""
    points = durable(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows_of_fp")))
    stars = components(near_links(points, radius))
    member = stars.union(stars.select("root", "root").distinct()).join(points.select(F.col("fp").alias("node"), "first"), "node")
    smallest = member.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = member.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    of_point = points.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "rows_of_fp")
    return joined_back(found, of_point, ["fp"], "rows_of_fp", found.count()).drop("rows_of_fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each row of docs.

    Words are runs without ASCII white space, A-Z lower-cased; shingles are of four
    words, repeats included. Fewer words: the whole sequence is the one shingle; none
    (empty or null text): fingerprint zero, linked like any other. component_id is the
    smallest doc_id that can be reached over links of `radius` differing bits or fewer,
    null only where no doc_id is known in the component. Repeated rows each give a row.
    """
    found = placed(durable(fingerprints(texts(docs))), radius)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is the smallest of the component of their own text.

    Rows are known by doc_id and text, of which the fingerprint is a function.
    """
    found = durable(fingerprints(texts(docs).withColumn("text_sha256", F.sha2("text", 256))))
    lost = placed(found, radius).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    return without(docs, lost, F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
