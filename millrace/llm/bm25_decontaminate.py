"""Benchmark decontamination: every passage against a BM25 index of test items.

The test items are indexed once; each passage of a training text is a query. Passages
overlap by half and are twice as long as the longest item, so any copy of an item lies
whole in one of them. Scores are divided by the item's score against itself, which
makes one threshold fit all items. Retrieval is block-max WAND: terms whose bounds
together stay below the threshold cannot carry an item, the others name the blocks of
items that may reach it, and only blocks whose bounds do are scored in full. What is
retrieved is verified by a longest common subsequence of the item's words and the
passage's, of which question and answer must each hold enough. A short last sentence may
be the answer or a part of it. In scripts without spaces each character is a word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, durable, texts

K1, B = 1.2, 0.75
BLOCK = 8
THRESHOLD = 0.6
#: Least shares of an item's words, of its question's and of its answer's that a passage has in order.
OVERLAP, QUESTION, ANSWER = 0.8, 0.7, 0.5
#: Characters of items in one broadcast index; a larger benchmark is searched in several.
INDEX_CHARS = 8_000_000
MIN_STRIDE = 64
#: Characters of the texts whose passages are searched at once.
PASSAGE_CHARS = 300_000
#: Thai to Khmer, kana, Han and Hangul-less blocks of scripts that set no spaces between words.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
ASCII_WORD, WORD = re.compile(r"\w+"), re.compile(rf"[^\W{UNSPACED}]+|[{UNSPACED}]")


def words_of(text: str) -> list[str]:
    """Lower-case words in order."""
    text = text.lower()
    return (ASCII_WORD if text.isascii() else WORD).findall(text)


def splits(text: str) -> tuple[list[str], tuple[int, int]]:
    """The words of an item and two places where its answer may begin.

    The first is the last sentence; of one sentence, the last quarter answers. The second
    goes back to a quarter of all words, rounded up, so that no single word decides.
    """
    parts = re.split(r"(?<=[.!?])\s+|(?<=[\u3002\uff01\uff1f])(?!$)", text.strip())
    question, answer = words_of(" ".join(parts[:-1])), words_of(parts[-1])
    words = question + answer
    last = len(question) if question else max(0, len(words) - max(1, len(words) // 4))
    return words, (last, min(last, len(words) - -(-len(words) // 4)))


def in_order(words: list[str], passage: list[str]) -> np.ndarray:
    """Which words are of a longest common subsequence of words and passage."""
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    other = np.array([code.get(w, -1) for w in passage], np.int64)
    length, grows = np.zeros(len(other) + 1, np.int32), []
    for w in words:
        length[1:] = np.maximum.accumulate(np.where(other == code[w], length[:-1] + 1, length[1:]))
        grows.append(np.packbits(np.diff(length) > 0))
    hit, upto = np.zeros(len(words), bool), len(other)
    before = [np.zeros(0, np.uint8), *grows[:-1]]
    for k in range(len(words) - 1, -1, -1):
        row = np.unpackbits(grows[k], count=len(other))[:upto]
        above = np.unpackbits(before[k], count=len(other))[:upto] if k else np.zeros(upto, np.uint8)
        if row.sum() > above.sum():  # without this word the rest is shorter
            hit[k] = True
            upto = int(np.nonzero(row)[0][-1])
    return hit


@dataclass
class Whole:
    """What weights and passages depend on, over all items of a benchmark: their number, mean and largest length, and in how many a word stands."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]


class Postings:
    """Sorted lists with weights, one after the other."""

    def __init__(self, at: list[np.ndarray], weight: list[np.ndarray]):
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int64)
        self.at = np.concatenate([np.zeros(0, np.int64), *at])
        self.weight = np.concatenate([np.zeros(0), *weight])

    def lists(self, of: str = "at") -> list[np.ndarray]:
        return np.split(getattr(self, of), self.first[1:-1]) if len(self.first) > 1 else []

    def expand(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, entry, weight) of the lists of all terms."""
        size = self.first[term + 1] - self.first[term]
        shift = self.first[term] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(term) else size
        at = np.repeat(shift, size) + np.arange(size.sum())
        return np.repeat(row, size), self.at[at], self.weight[at]


class Index:
    """Postings of normalised BM25 weights, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], whole: Whole | None = None):
        """whole: of the benchmark that items are a part of; without it they are all of it."""
        self.items = [x for x in ((i, *splits(t)) for i, t in items) if x[1]]
        words = [w for _, w, _ in self.items]
        if whole is None:
            sizes = [len(w) for w in words]
            whole = Whole(len(words), float(np.mean(sizes)) if sizes else 1.0, max(sizes, default=0), Counter(w for d in words for w in set(d)))
        self.stride = max(MIN_STRIDE, whole.longest)
        n, mean, df = whole.n, max(1.0, whole.mean), whole.df
        self.term = {w: k for k, w in enumerate(sorted({w for d in words for w in d}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for k, d in enumerate(words):
            weight = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean)) for w, tf in Counter(d).items()}
            total = sum(weight.values())
            for w, x in weight.items():
                postings[self.term[w]].append((k, x / total))
        self.blocks = max(1, -(-len(self.items) // BLOCK))
        self.items_of = Postings([np.array([k for k, _ in p], np.int64) for p in postings], [np.array([x for _, x in p]) for p in postings])
        first = [np.concatenate([[0], np.nonzero(np.diff(a // BLOCK))[0] + 1]) for a in self.items_of.lists()]
        self.blocks_of = Postings(
            [a[f] // BLOCK for a, f in zip(self.items_of.lists(), first, strict=True)],
            [np.maximum.reduceat(w, f) for w, f in zip(self.items_of.lists("weight"), first, strict=True)],
        )
        self.bound = np.array([w.max() for w in self.items_of.lists("weight")] + [0.0])

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) wherever an item's score against the distinct terms of a passage reaches the threshold.

        passage, term: one entry for each term of each passage, passages numbered from 0.
        """
        order = np.lexsort((self.bound[term], passage))
        passage, term = passage[order], term[order]
        upto = np.cumsum(self.bound[term])
        start = np.searchsorted(passage, passage)
        within = upto - upto[start] + self.bound[term[start]]
        # Terms up to the pivot stay below the threshold together; an item needs another one.
        essential = within >= threshold - 1e-9
        rows, block, _ = self.blocks_of.expand(passage[essential], term[essential])
        named = np.unique(rows * self.blocks + block)
        rows, block, weight = self.blocks_of.expand(passage, term)
        key = rows * self.blocks + block
        at = np.searchsorted(named, key)
        there = at < len(named)
        there[there] = named[at[there]] == key[there]
        bounds = np.bincount(at[there], weight[there], len(named))
        named = named[bounds >= threshold - 1e-9]
        busy = np.isin(passage, named // self.blocks)
        rows, item, weight = self.items_of.expand(passage[busy], term[busy])
        key = rows * self.blocks + item // BLOCK
        at = np.minimum(np.searchsorted(named, key), max(0, len(named) - 1))
        there = named[at] == key if len(named) else np.zeros(len(key), bool)
        found, back = np.unique(rows[there] * len(self.items) + item[there], return_inverse=True)
        score = np.bincount(back, weight[there], len(found))
        found, score = found[score >= threshold], score[score >= threshold]
        return found // max(1, len(self.items)), found % max(1, len(self.items)), score

    def verify(self, item: int, passage: list[str]) -> tuple[float, float] | None:
        """Shares of question and answer that the passage has in order, at the first split where both are enough; None if too little."""
        _, words, cuts = self.items[item]
        if sum((Counter(words) & Counter(passage)).values()) < OVERLAP * len(words):
            return None
        hit = in_order(words, passage)
        if hit.mean() < OVERLAP:
            return None
        shares = [tuple(float(x.mean()) if len(x) else 1.0 for x in (hit[:cut], hit[cut:])) for cut in cuts]
        return next((share for share in shares if share[0] >= QUESTION and share[1] >= ANSWER), None)

    def leaks(self, texts: list[str]) -> list[tuple[int, int, float, float, float]]:
        """(position of the text, item_id, score, question share, answer share): the best passage for each verified item."""
        found: dict[tuple[int, int], tuple] = {}
        if not self.items:
            return []
        for first, stop in blocks([len(t) for t in texts], PASSAGE_CHARS):
            words = [words_of(t) for t in texts[first:stop]]
            size = np.array([len(w) for w in words])
            ids = np.fromiter(map(self.term.get, chain.from_iterable(words), repeat(-1)), np.int64, size.sum())
            # Passages of two strides each; every word but those at a text's ends is in two.
            count = np.maximum(1, -(-size // self.stride) - 1)
            base = np.concatenate([[0], np.cumsum(count)])
            doc = np.repeat(np.arange(len(words)), size)
            stride = (np.arange(len(ids)) - np.concatenate([[0], np.cumsum(size)[:-1]])[doc]) // self.stride
            known = ids >= 0
            doc, stride, ids = doc[known], stride[known], ids[known]
            keys = [(base[doc] + p)[ok] * len(self.bound) + ids[ok] for p in (stride, stride - 1) if len(ok := (p >= 0) & (p < count[doc]))]
            keys = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            for passage, item, score in zip(*(x.tolist() for x in self.retrieve(keys // len(self.bound), keys % len(self.bound))), strict=True):
                k = int(np.searchsorted(base, passage, "right")) - 1
                start = (passage - int(base[k])) * self.stride
                if (shares := self.verify(item, words[k][start : start + 2 * self.stride])) is not None:
                    key, row = (first + k, self.items[item][0]), (first + k, self.items[item][0], score, *shares)
                    found[key] = max(found.get(key, row), row)
        return [found[k] for k in sorted(found)]


class Indexes(Sequence):
    """The indexes of a benchmark's parts, each made from all items' figures when it is asked for and not kept."""

    def __init__(self, items: DataFrame, parts: int):
        self.parts, self.items = parts, items
        if parts > 1:
            self.items = durable(items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts))).mapInArrow(_with_words, "part long, item_id long, text string, words array<string>"))
            self.some = self.items.filter("size(words) > 0")
            self.n, self.mean, self.longest = self.some.agg(F.count(F.lit(1)), F.avg(F.size("words")), F.max(F.size("words"))).first()
            self.df = durable(self.some.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")))

    def __len__(self) -> int:
        return self.parts

    def __getitem__(self, k: int) -> Index:
        if not 0 <= k < self.parts:
            raise IndexError(k)
        if self.parts == 1:
            return Index(sorted(map(tuple, self.items.collect())))
        own = self.some.filter(F.col("part") == k)
        df = self.df.join(own.select(F.explode("words").alias("word")).distinct(), "word", "left_semi")
        whole = Whole(self.n, self.mean or 1.0, self.longest or 0, {r["word"]: r["n"] for r in df.collect()})
        return Index(sorted(map(tuple, own.select("item_id", "text").collect())), whole)


def _with_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [splits(t)[0] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("item_id"), batch.column("text"), pa.array(words, pa.list_(pa.string()))], ["part", "item_id", "text", "words"])


def indexes(benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> Indexes:
    """One index, or several for a benchmark larger than one may be, with the same weights; null and repeated items count once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(benchmark["text"].cast("string"), F.lit("")).alias("text")).filter("item_id is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return Indexes(items, max(1, -(-chars // index_chars)))


def each_part(benchmark: DataFrame, index_chars: int, search: Callable[[Broadcast], DataFrame]) -> Iterator[DataFrame]:
    """What search makes with each index; all but the last are computed, and their index released, before the next is made."""
    parts = indexes(benchmark, index_chars)
    for k in range(len(parts)):
        shared = benchmark.sparkSession.sparkContext.broadcast(parts[k])
        found = search(shared)
        if k < len(parts) - 1:
            found = durable(found)
            shared.destroy()
        yield found


def leaked_items(docs: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each benchmark item that a text holds.

    Every passage of every whole text is searched where it is read, without a shuffle.
    Null or empty texts and items hold nothing; repeated rows each give their rows;
    other columns are ignored; an item with one text only is listed by its id.
    """
    docs = texts(docs)

    def leaked(shared: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[k], *hit) for k, *hit in index.leaks(batch.column("text").to_pylist())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return docs.mapInArrow(search, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    return reduce(DataFrame.union, each_part(benchmark, index_chars, leaked))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item.

    Each row is judged by its own whole text, whatever its doc_id: null and empty texts
    stay, repeated rows stay or go together. Null and repeated items count once; without
    items, or of an empty table, all rows stay.
    """

    def clean(shared: Broadcast) -> DataFrame:
        @F.pandas_udf("boolean")
        def leaks(text: pd.Series) -> pd.Series:
            held = {k for k, *_ in shared.value.leaks(text.tolist())}
            return pd.Series([k in held for k in range(len(text))], dtype=bool)

        return docs.filter(~leaks(F.coalesce(docs["text"].cast("string"), F.lit(""))))

    for docs in each_part(benchmark, index_chars, clean):  # noqa: B007 - the next part searches what this one left
        pass
    return docs
