"""Quality scores from gradient-boosted trees over statistics of whole texts.

A text is reduced to STATISTICS: shares of kinds of characters and words, lengths,
repetition of words, word pairs and lines. They are made in numpy where a text is read,
a block of texts at a time. Trees are grown on the driver from a bounded sample of
labelled texts, by histograms: each statistic is cut into at most BINS bins at its
quantiles, and a level of a tree finds the best cut of all its nodes from sums of
gradients by bin. A grown model is three arrays of complete trees, and scoring walks all
texts of a block down all trees a level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, texts
from millrace.llm.subword_toxicity import held_out

#: Bound on what the driver grows trees from: labelled texts, of which only the statistics reach it.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 120, 4, 64, 0.15
#: Least sum of second derivatives in a leaf, and what is added to it, which keep leaves of few rows small.
LEAST, RIDGE = 2.0, 1.0
#: score >= KEEP is predicted 1.
KEEP = 0.3

LETTER, UPPER, DIGIT, SPACE, NEWLINE, STOP, SYMBOL = (1 << k for k in range(7))
STATISTICS = (
    "log_chars", "log_words", "log_lines", "letters", "upper", "digits", "spaces", "stops", "symbols", "beyond_ascii", "repeated_char", "char_entropy",
    "word_length", "word_spread", "longest_word", "capitalised", "all_caps", "ends_in_stop", "ends_in_symbol", "without_letters",
    "repeated_word", "distinct_words", "top_word", "distinct_pairs", "top_pair", "line_length", "repeated_lines", "lines_with_stop",
)

_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Kind flags of every code point, made once for a process."""
    if not _kinds:
        flags = np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            flags[i] = LETTER * c.isalpha() | UPPER * c.isupper() | DIGIT * c.isdigit() | SPACE * c.isspace() | NEWLINE * (c == "\n") | STOP * (c in ".,;:?!。，、；：？！…") | SYMBOL * (not c.isalnum() and not c.isspace())
        _kinds.append(flags)
    return _kinds[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Runs:
    """Maximal runs of characters of one text that are not cut out: where they start and stop, whose they are, and a hash of each."""

    def __init__(self, code: np.ndarray, owner: np.ndarray, inside: np.ndarray):
        edge = np.ones(len(code), bool)
        edge[1:] = owner[1:] != owner[:-1]
        begins = inside & (edge | ~np.concatenate([[False], inside[:-1]]))
        self.start = np.flatnonzero(begins)
        ends = inside & np.concatenate([edge[1:] | ~inside[1:], [True]])[: len(code)]
        self.stop = np.flatnonzero(ends) + 1
        self.owner, self.size = owner[self.start], self.stop - self.start
        place = np.arange(len(code)) - np.repeat(np.concatenate([[0], self.start]), np.diff(np.concatenate([[0], self.start, [len(code)]])))
        part = np.where(inside, _mixed(code.astype(np.uint64) + place.astype(np.uint64) * np.uint64(0x100000001B3)), np.uint64(0))
        self.hash = np.add.reduceat(part, self.start) if len(self.start) else np.zeros(0, np.uint64)


def _share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return count / np.maximum(of, 1)


def _variety(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: how many different hashes it has, and how often it has its most frequent one."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])) if len(h) else np.zeros(0, np.int64)
    times, top = np.diff(np.concatenate([first, [len(h)]])), np.zeros(n)
    np.maximum.at(top, o[first], times)
    return np.bincount(o[first], minlength=n), top


def statistics(some: list[str]) -> np.ndarray:
    """STATISTICS of whole texts, a row for each; all are 0 for an empty text."""
    n = len(some)
    sizes = np.array([len(t) for t in some], np.int64)
    code = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.zeros((n, len(STATISTICS)))
    owner = np.repeat(np.arange(n), sizes)
    flag = kinds()[code]
    each = lambda mask: np.bincount(owner[mask], minlength=n)
    out = {name: _share(each((flag & bit) > 0), sizes) for name, bit in (("letters", LETTER), ("upper", UPPER), ("digits", DIGIT), ("spaces", SPACE), ("stops", STOP), ("symbols", SYMBOL))}
    out["beyond_ascii"] = _share(each(code > 127), sizes)
    same = np.concatenate([[False], (code[1:] == code[:-1]) & (owner[1:] == owner[:-1])])
    out["repeated_char"] = _share(each(same), sizes)
    bins = np.bincount(owner * 256 + (code & 255), minlength=n * 256).reshape(n, 256) / np.maximum(sizes, 1)[:, None]
    out["char_entropy"] = -(bins * np.log2(np.where(bins > 0, bins, 1))).sum(1)

    words = _Runs(code, owner, (flag & SPACE) == 0)
    count = np.bincount(words.owner, minlength=n)
    of_words = lambda mask: _share(np.bincount(words.owner[mask], minlength=n), count)
    total, squares = (np.bincount(words.owner, words.size.astype(float) ** k, n) for k in (1, 2))
    out["word_length"] = _share(total, count)
    out["word_spread"] = np.sqrt(np.maximum(0, _share(squares, count) - out["word_length"] ** 2))
    longest = np.zeros(n)
    np.maximum.at(longest, words.owner, np.log1p(words.size))
    out["longest_word"] = longest
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    inside = lambda mask: (lambda c: c[words.stop] - c[words.start])(upto(mask))
    letters, uppers = inside((flag & LETTER) > 0), inside((flag & UPPER) > 0)
    first, last = flag[words.start], flag[words.stop - 1]
    out["capitalised"] = of_words((first & UPPER) > 0)
    out["all_caps"] = of_words((uppers > 1) & (uppers == letters))
    out["ends_in_stop"] = of_words((last & STOP) > 0)
    out["ends_in_symbol"] = of_words(((last & SYMBOL) > 0) & ((last & STOP) == 0))
    out["without_letters"] = of_words(letters == 0)
    follows = np.concatenate([[False], words.owner[1:] == words.owner[:-1]])[: len(words.owner)]
    before = np.concatenate([words.hash[:1], words.hash[:-1]])
    out["repeated_word"] = of_words(follows & (words.hash == before))
    different, top = _variety(words.hash, words.owner, n)
    out["distinct_words"], out["top_word"] = _share(different, count), _share(top, count)
    pairs = np.maximum(count - 1, 0)
    different, top = _variety(_mixed(before)[follows] + words.hash[follows], words.owner[follows], n)
    out["distinct_pairs"], out["top_pair"] = _share(different, pairs), _share(top, pairs)

    lines = _Runs(code, owner, (flag & NEWLINE) == 0)
    rows = np.bincount(lines.owner, minlength=n)
    out["line_length"] = np.log1p(_share(np.bincount(lines.owner, lines.size, n), rows))
    out["repeated_lines"] = 1 - np.where(rows, _share(_variety(lines.hash, lines.owner, n)[0], rows), 1)
    out["lines_with_stop"] = _share(np.bincount(lines.owner[(flag[lines.stop - 1] & STOP) > 0], minlength=n), rows)
    out |= {"log_chars": np.log1p(sizes), "log_words": np.log1p(count), "log_lines": np.log1p(rows)}
    return np.stack([np.where(sizes > 0, out[name], 0.0) for name in STATISTICS], 1)


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth, level by level: node k has children 2k+1 (value <= cut) and 2k+2."""

    feature: np.ndarray  # (trees, nodes)
    cut: np.ndarray  # (trees, nodes)
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of x reaches, over all trees at once."""
        tree, row = np.arange(len(self.leaf))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(int(self.leaf.shape[1]).bit_length() - 1):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.leaf[tree, node - self.feature.shape[1]].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """Values between the bins of each column, at quantiles of its rows."""
    return [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for column in x.T]


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the log odds of y. With labels of one kind only, no trees: the score is their share."""
    nodes, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    share = float(y.mean()) if len(y) else 0.0
    base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if len(set(y.tolist())) < 2:
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)), base)
    cuts = _cuts(x)
    bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], 1)
    columns = bins.shape[1]
    # The cut at edge b sends bins up to b left; edges past the last one of a column split nothing.
    edges = np.full((columns, BINS), np.inf)
    for k, c in enumerate(cuts):
        edges[k, : len(c)] = c
    flat = bins + np.arange(columns) * BINS
    margin, made = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width = 1 << level
            at = ((node - (width - 1))[:, None] * (columns * BINS) + flat).ravel()
            gs, hs = (np.bincount(at, np.repeat(v, columns), width * columns * BINS).reshape(width, columns, BINS).cumsum(2) for v in (g, h))
            g_all, h_all = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + RIDGE) + (g_all - gs) ** 2 / (h_all - hs + RIDGE) - g_all**2 / (h_all + RIDGE)
            gain[(hs < LEAST) | (h_all - hs < LEAST) | np.isinf(edges)[None]] = 0
            best = gain.reshape(width, -1).argmax(1)
            splits = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            ids = np.arange(width) + width - 1
            feature[ids] = np.where(splits, best // BINS, 0)
            cut[ids] = np.where(splits, edges[best // BINS, best % BINS], np.inf)
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        place = node - nodes
        leaf = -RATE * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + RIDGE)
        margin = margin + leaf[place]
        made.append((feature, cut, leaf))
    return Trees(*(np.stack(part) for part in zip(*made, strict=True)), base)


def _statistics_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        some = batch.column("text").to_pylist()
        for first, stop in blocks([len(t) for t in some]):
            rows = statistics(some[first:stop])
            yield pa.RecordBatch.from_arrays([batch.column("id")[first:stop], batch.column("y")[first:stop], pa.array(rows.tolist(), pa.list_(pa.float64()))], ["id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most train_rows labelled rows outside the held-out fold, taken in hash order of doc_id.

    Null labels and labels without a document teach nothing. The statistics of whole
    texts are made by Spark; the driver gets those of at most train_rows rows, however
    often a doc_id is repeated.
    """
    known = labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), (F.col("quality").cast("int") > 0).cast("int").alias("y")).filter(~held_out(F.col("id")))
    chosen = known.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)
    rows = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "y", "text")
    sample = rows.mapInArrow(_statistics_of, "id long, y int, x array<double>").orderBy(F.xxhash64("id"), "id", "y", "x").limit(train_rows).toPandas()
    x = np.stack(sample["x"].tolist()) if len(sample) else np.zeros((0, len(STATISTICS)))
    return grow(x, sample["y"].to_numpy(np.int64))


def quality(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from KEEP on): one row for each row of docs, scored where it is read.

    Whole texts are scored. A null or empty text has the score of statistics that are all
    0; a null doc_id is not held out; repeated rows each give a row; other columns are
    ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column("text").to_pylist()
            for first, stop in blocks([len(t) for t in some]):
                scores = shared.value.probability(statistics(some[first:stop]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:stop], batch.column("held_out")[first:stop], pa.array(scores, pa.float64()), pa.array((scores >= KEEP).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return texts(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
