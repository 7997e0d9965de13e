"""Ranked lexical search over hashed max-sketches of documents.

A document's impact of a term is what it gives to a score before the term's weight. Its
sketch folds the impacts of all its terms into WIDTH coordinates by hash, each keeping
the highest. The sum, over a query's terms, of weight times the coordinate of the term
is then an upper bound of the document's score: a coordinate is the term's own impact or
a larger one of a term that shares it. Bounds of a block of documents are looked up for
all queries together; a query then scores the documents of the block exactly, in
descending order of bounds, until no bound left reaches its lowest kept score.

Documents are searched where they are read. A task keeps the best of each query and
sends those; the best of all tasks are ranked in one aggregate. Terms, impacts and scores
are 64-bit integers, so results do not depend on how documents are dealt over tasks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import blocks, durable, texts

#: Coordinates of a sketch; only those that a query looks up are kept in memory.
WIDTH = 1 << 13
#: Documents searched together: at most so many, and of so many characters.
BLOCK_ROWS, BLOCK_CHARS = 512, 1 << 21
#: Bytes of query text for which one scan of the documents searches; more queries take more scans.
QUERY_BYTES = 8 << 20
#: Documents that a query returns.
TOP = 50

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text: str) -> list[str]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased."""
    return WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_factor(sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of documents with so many terms, of n documents with terms and total terms in all."""
    return 100 - 50 + (50 * sizes * n) // max(1, total)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class Coordinates(dict):
    """Coordinate of each term met, the same in every process."""

    def __init__(self, width: int):
        self.width = width

    def __missing__(self, term: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[term] = out = zlib.crc32(term.encode("utf-8", "surrogatepass")) % self.width
        return out


@dataclass
class Queries:
    """A part of the queries, with the corpus figures that their scores need."""

    ids: list[int | None]
    terms: list[list[str]]  # distinct
    df: dict[str, int]
    n: int
    total: int
    width: int = WIDTH

    def __post_init__(self):
        self.weights = [np.array([weight(self.n, self.df.get(t, 0)) for t in terms], np.int64) for terms in self.terms]
        spot = Coordinates(self.width)
        at = [np.array([spot[t] for t in terms], np.int64) for terms in self.terms]
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *at]))
        #: Row of the kept sketch for each coordinate; the last row takes what no query looks up.
        self.row = np.full(self.width, len(used), np.int64)
        self.row[used] = np.arange(len(used))
        self.rows, self.kept = [self.row[a] for a in at], len(used)


class Search:
    """The best documents of each query among those added so far: (score, doc_id, order), best first."""

    def __init__(self, queries: Queries, top: int):
        self.queries, self.top, self.spot = queries, top, Coordinates(queries.width)
        self.best: list[list[tuple]] = [[] for _ in queries.ids]
        self.bounded = self.rescored = 0

    def add(self, ids: list[int | None], some: list[str]) -> None:
        q = self.queries
        counts = [Counter(terms_of(t)) for t in some]
        sizes = np.array([c.total() for c in counts], np.int64)
        distinct = np.array([len(c) for c in counts], np.int64)
        doc = np.repeat(np.arange(len(some)), distinct)
        m = length_factor(sizes, q.n, q.total)
        tf = np.fromiter((k for c in counts for k in c.values()), np.int64, distinct.sum())
        at = np.fromiter((self.spot[t] for c in counts for t in c), np.int64, distinct.sum())
        sketch = np.zeros((q.kept + 1, len(some)), np.int64)
        np.maximum.at(sketch, (q.row[at], doc), impacts(tf, m[doc]))
        factor = m.tolist()
        for k, (rows, weights, terms) in enumerate(zip(q.rows, q.weights, q.terms, strict=True)):
            bound = weights @ sketch[rows] if len(rows) else np.zeros(len(some), np.int64)
            best = self.best[k]
            floor = best[-1][0] if len(best) == self.top else 1
            open_ = np.flatnonzero(bound >= floor)
            self.bounded += len(some)
            pairs = list(zip(terms, weights.tolist(), strict=True))
            for d in open_[np.argsort(-bound[open_], kind="stable")].tolist():
                if bound[d] < floor:
                    break
                self.rescored += 1
                tf_of, m20 = counts[d], 20 * factor[d]
                score = sum(w * (1_000_000_000 * x // (1000 * x + m20)) for t, w in pairs if (x := tf_of.get(t)))
                if score >= floor:
                    best.append((score, ids[d]))
                    if len(best) >= 2 * self.top:
                        floor = self._trim(k)
                        best = self.best[k]
            if len(best) >= self.top:
                self._trim(k)

    def _trim(self, k: int) -> int:
        """Keeps the best and returns the score that a document must reach from now on."""
        best = self.best[k] = sorted(self.best[k], key=_rank)[: self.top]
        return best[-1][0] if len(best) == self.top else 1

    def rows(self) -> list[tuple]:
        return [(self.queries.ids[k], i, s) for k, best in enumerate(self.best) for s, i in sorted(best, key=_rank)[: self.top]]


def _rank(found: tuple) -> tuple:
    score, doc_id = found
    return -score, doc_id is None, doc_id or 0


def _counts(words: frozenset[str]):
    """Task that counts, over its documents, those with any term (term null), their terms, and those that hold each term of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, total = Counter(), 0, 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                terms = terms_of(text)
                documents, total = documents + bool(terms), total + len(terms)
                df.update(words.intersection(terms))
        yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.string()), pa.array([documents, *df.values()], pa.int64()), pa.array([total] + [0] * len(df), pa.int64())], ["term", "df", "total"])

    return count


def _parts(items: DataFrame, query_bytes: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The queries, (item_id, distinct terms), as many at a time as their texts fill query_bytes."""
    sized = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-sized // query_bytes))
    if parts > 1:
        items = durable(items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts))))
    for part in range(parts):
        own = items.filter(F.col("part") == part) if parts > 1 else items
        terms: dict[int | None, dict[str, None]] = {}
        for row in own.select("item_id", "text").collect():
            terms.setdefault(row["item_id"], {}).update(dict.fromkeys(terms_of(row["text"])))
        yield [(i, sorted(t)) for i, t in sorted(terms.items(), key=lambda x: (x[0] is None, x[0] or 0))]


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES, width: int = WIDTH) -> DataFrame:
    """item_id, rank, doc_id, score: the top documents with a score above 0 of each item, equal scores by doc_id, null last.

    docs (doc_id, text) and items (item_id, text) may have other columns. Null or empty
    texts have no terms: such documents are found by no item and count in no figure, such
    items find nothing. Repeated rows of docs are documents of their own; texts of one
    item_id, null too, are one item with the terms of all. Two reads of docs for each
    query_bytes of items: one for the corpus figures, one for the search.
    """
    docs = texts(docs)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(items["text"].cast("string"), F.lit("")).alias("text"))
    return reduce(DataFrame.union, [_searched(docs, part, top, width) for part in _parts(items, query_bytes)])


def _searched(docs: DataFrame, part: list[tuple[int | None, list[str]]], top: int, width: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    words = frozenset(t for _, terms in part for t in terms)
    counted = docs.mapInArrow(_counts(words), "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    # One row for each term of the part's queries at most.
    figures = {r["term"]: (r["df"], r["total"]) for r in counted.collect()}
    n, total = figures.pop(None, (0, 0))
    shared = context.broadcast(Queries([i for i, _ in part], [t for _, t in part], {t: df for t, (df, _) in figures.items()}, n, total, width))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(shared.value, top)
        for batch in batches:
            ids, some = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for first, stop in blocks([max(len(t), BLOCK_CHARS // BLOCK_ROWS) for t in some], BLOCK_CHARS):
                found.add(ids[first:stop], some[first:stop])
        rows = found.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item_id", "doc_id", "score"])

    best = docs.mapInArrow(search, "item_id long, doc_id long, score long")
    # A task sends at most top rows of an item, so an item's rows grow with tasks only; those of groups of tasks are ranked first.
    best = best.withColumn("task", F.spark_partition_id())
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for by in (["item_id", F.floor(F.col("task") / 64)], ["item_id"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("item_id", "rank", "doc_id", "score")
