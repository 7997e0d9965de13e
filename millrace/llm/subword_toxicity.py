"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the mean of the vectors of its character n-grams, a passage of WINDOW words
the mean of its words, and a softmax over two classes reads that mean. A document is
toxic if any of its passages is, so the loss of a document is that of its most toxic
passage. Vectors and softmax are trained jointly in numpy on a bounded sample of
labelled documents: first on passages drawn from them, to tell which is which, then
with that pooling inside the loss. An unseen misspelling shares most n-grams with the
word meant and so its vector.

As all is linear between n-grams and softmax, what is broadcast is one weight for each
of 2 ** BITS n-gram buckets (1 MB), the difference of the two classes: a word scores the
mean of its weights, a passage the mean of its words, and the softmax of the highest
passage is the score of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import texts

WINDOW = 4
SIZES = (4, 5, 6)
BITS = 18
DIM = 8
#: Bounds on what the driver trains on: labelled documents, and characters of each; of a longer one, pieces from all over it.
TRAIN_ROWS = 6000
TRAIN_CHARS, PIECE_CHARS = 40_000, 2_000
MEMO = 500_000
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """Lower-case words in order; a word said again and again counts once."""
    return [w for w, _ in groupby(WORD.findall(text.lower()))]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of all words, marked at both ends, and for each the position of its word."""
    code = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters from here to the word's end
    buckets, owners, h = [], [], np.zeros(len(code), np.uint64)
    for n in range(1, SIZES[-1] + 1):
        h = h[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n in SIZES:
            fits = left[: len(h)] >= n
            mixed = (h[fits] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[: len(h)][fits])
    bucket, owner = np.concatenate(buckets), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return bucket[order], owner[order]


def _grams_of_many(words: list[str], some: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """grams of any number of words, made a few at a time and kept small."""
    buckets, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at in range(0, len(words), some):
        bucket, owner = grams(words[at : at + some])
        buckets.append(bucket.astype(np.int32))
        owners.append((owner + at).astype(np.int32))
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass(frozen=True)
class Model:
    """The softmax of two classes as the logistic function of their difference."""

    weights: np.ndarray  # of the buckets
    bias: float

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top + self.bias, -30, 30)))


def passages(n: int) -> np.ndarray:
    """First words of the passages of a text of n words; every word is in one at least."""
    starts = np.arange(0, max(1, n - WINDOW + 1), WINDOW // 2)
    return starts if n <= WINDOW or starts[-1] == n - WINDOW else np.append(starts, n - WINDOW)


def highest(scores: np.ndarray) -> tuple[float, int]:
    """Score and first word of the highest passage, given each word's score; no words: 0."""
    if not len(scores):
        return 0.0, 0
    total, starts = np.concatenate([[0.0], np.cumsum(scores)]), passages(len(scores))
    stops = np.minimum(starts + WINDOW, len(scores))
    means = (total[stops] - total[starts]) / WINDOW
    k = int(np.argmax(means))
    return float(means[k]), int(starts[k])


class Scorer:
    """Scores of whole texts; words met before are remembered."""

    def __init__(self, model: Model):
        self.model, self.of_word = model, {}

    def learn(self, words: list[str]) -> None:
        if len(self.of_word) >= MEMO:
            self.of_word.clear()
        for at in range(0, len(words), 50_000):
            some = words[at : at + 50_000]
            bucket, owner = grams(some)
            total = np.bincount(owner, self.model.weights[bucket], len(some)) / np.maximum(1, np.bincount(owner, minlength=len(some)))
            self.of_word.update(zip(some, total.tolist(), strict=True))

    def scores(self, texts: list[str]) -> list[float]:
        docs = [words_of(t) for t in texts]
        known = self.of_word
        fresh = {w for d in docs for w in d if w not in known}
        if fresh:
            if len(known) + len(fresh) > MEMO:
                fresh |= {w for d in docs for w in d}
            self.learn(list(fresh))
        top = np.array([highest(np.array([known[w] for w in d], np.float64))[0] for d in docs], np.float64)
        return self.model.probability(top).tolist()


_scorers: list[Scorer] = []


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer of this model, with the words it knows."""
    if not _scorers or _scorers[0].model is not model:
        _scorers[:] = [Scorer(model)]
    return _scorers[0]


class Trainer:
    """Vectors of the buckets and the softmax over their means, by Adagrad."""

    def __init__(self, documents: list[str], labels: np.ndarray, seed: int = 7):
        self.rng, self.y = np.random.default_rng(seed), labels
        ids: dict[str, int] = {}
        self.docs = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int32) for t in documents]
        self.flat, self.owner = _grams_of_many(list(ids))
        self.size = np.bincount(self.owner, minlength=len(ids))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        # Vectors start at zero, so an n-gram that no label has moved says nothing.
        self.vectors = np.zeros((1 << BITS, DIM), np.float32)
        self.softmax, self.bias = self.rng.normal(0, 1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
        self.vectors_g2, self.softmax_g2, self.bias_g2 = np.full(1 << BITS, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
        self.share = max(1e-3, float(labels.mean()))

    def buckets(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words in a row, and for each the position of its word."""
        size = self.size[words]
        owner = np.repeat(np.arange(len(words)), size)
        return self.flat[np.repeat(self.first[words] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())], owner

    def step(self, docs: np.ndarray, starts: np.ndarray, rate: float, balanced: bool) -> None:
        """One step down the cross entropy of a passage of each document; balanced: both classes weigh the same."""
        words = [self.docs[i][s : s + WINDOW] for i, s in zip(docs, starts, strict=True)]
        passage = np.repeat(np.arange(len(docs)), [len(w) for w in words])
        words = np.concatenate(words)
        bucket, owner = self.buckets(words)
        share = (1 / (np.maximum(1, self.size[words]) * WINDOW)).astype(np.float32)[owner]
        of = passage[owner]
        mean = np.stack([np.bincount(of, self.vectors[bucket, k] * share, len(docs)) for k in range(DIM)], 1).astype(np.float32)
        logits = mean @ self.softmax + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weight = np.where(self.y[docs] == 1, 0.5 / self.share, 0.5 / (1 - self.share)).astype(np.float32) if balanced else np.ones(len(docs), np.float32)
        error = (p - np.eye(2, dtype=np.float32)[self.y[docs]]) * weight[:, None] / len(docs)
        back, turn = error @ self.softmax.T, mean.T @ error
        touched, place = np.unique(bucket, return_inverse=True)
        grad = np.stack([np.bincount(place, back[of, k] * share, len(touched)) for k in range(DIM)], 1).astype(np.float32)
        self.vectors_g2[touched] += (grad**2).mean(1)
        self.vectors[touched] -= rate * grad / np.sqrt(self.vectors_g2[touched])[:, None]
        self.softmax_g2 += turn**2
        self.softmax -= rate * turn / np.sqrt(self.softmax_g2)
        self.bias_g2 += error.sum(0) ** 2
        self.bias -= rate * error.sum(0) / np.sqrt(self.bias_g2)

    def word_scores(self) -> np.ndarray:
        weights = self.weights()
        return np.bincount(self.owner, weights[self.flat], len(self.size)) / np.maximum(1, self.size)

    def weights(self) -> np.ndarray:
        return (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)

    def train(self, warm: int = 4, rounds: int = 20, batch: int = 128, rate: float = 0.3) -> Model:
        use = np.array([i for i, d in enumerate(self.docs) if len(d)], np.int64)
        tops = []
        for turn in range(warm + rounds):
            pooled = turn >= warm
            if pooled:
                scores = self.word_scores()
                tops = [highest(scores[self.docs[i]])[1] for i in use]
            order = self.rng.permutation(len(use))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                docs = use[some]
                starts = [tops[k] for k in some] if pooled else [int(self.rng.choice(passages(len(self.docs[i])))) for i in docs]
                self.step(docs, np.array(starts), rate, not pooled)
        return Model(self.weights(), float(self.bias[1] - self.bias[0]))


def held_out(doc_id) -> F.Column:
    """True for the fold that no label is learned from; a null doc_id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model from at most train_rows labelled rows outside the held-out fold, taken in hash order of doc_id.

    Of a text longer than TRAIN_CHARS, pieces of PIECE_CHARS at even distances are learned
    from. Null labels teach nothing. Without rows of both kinds the model is constant: the
    share of toxic rows, or 0.
    """
    known = labels.filter("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), (F.col("toxic").cast("int") > 0).cast("int").alias("y")).filter(~held_out(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)
    pieces = TRAIN_CHARS // PIECE_CHARS
    step = (F.length("text") - PIECE_CHARS) / (pieces - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.substring(F.col("text"), F.floor(k * step).cast("int") + 1, F.lit(PIECE_CHARS)))
    learned = F.when(F.length("text") > TRAIN_CHARS, F.array_join(spread, " ")).otherwise(F.col("text"))
    # At most train_rows rows, so the documents need not move.
    rows = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", learned.alias("text")).toPandas().sort_values(["id", "y", "text"])
    y = rows["y"].to_numpy(np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    return Trainer(rows["text"].tolist(), y).train()


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs, scored where it is read.

    Whole texts are scored. A null or empty text has the score of no words; a null
    doc_id is not held out; repeated rows each give a row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                scores = scorer.scores(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return texts(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic.

    Each row is judged by its own whole text: a null or empty one has the score of no
    words, whatever its doc_id, and repeated rows stay or go together. Labels without a
    row of docs, null labels and the held-out fold teach nothing; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("boolean")
    def toxic(text):
        scorer = scorer_of(shared.value)
        return pd.Series([s >= 0.5 for at in range(0, len(text), 512) for s in scorer.scores(text.iloc[at : at + 512].tolist())], dtype=bool)

    return docs.filter(~toxic(F.coalesce(docs["text"].cast("string"), F.lit(""))))
