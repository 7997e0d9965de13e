"""Hard negatives, ranked search and quality scores against brute force."""

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import quality_trees, russian_negatives, sketch_search

VECTORS = "vec_id long, embedding array<float>, label int"


def negatives_model(rows, every=50):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    best = lambda scored: sorted(scored, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for k, (anchor, v, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        others = [(dot(v, w), i, own) for j, (i, w, own) in enumerate(kept) if j != k]
        for p, positive, _ in best([o for o in others if o[2] == label])[:5]:
            found = best([o for o in others if o[2] != label and 50 * p <= 100 * o[0] <= 95 * p])[:3]
            out += [(anchor, positive, rank, i, p, n) for rank, (n, i, _) in enumerate(found, 1)]
    return sorted(out, key=repr)


def negatives_of(df):
    found = russian_negatives.hard_negatives(df, lambda i: i % 50 == 0, lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label))
    return sorted((tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


def vectors(rng, n, width=20, scale=0.3, labels=3):
    return [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize(("width", "scale"), [(20, 0.3), (64, 0.1), (3, 90.0)])
def test_hard_negatives(spark, monkeypatch, width, scale):
    rng = random.Random(width)
    rows = vectors(rng, 420, width, scale)
    rows += [(1000 + i, rows[7][1], rng.randrange(3)) for i in range(40)]  # ties
    rows += [(2000, [0.0] * width, 0), (2050, [0.0] * width, 1), (2100, [-2.0] * width, 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumns({"row_id": F.lit("clash"), "n": F.lit("clash"), "planes": F.lit(1)}).repartition(3)
    want = negatives_model(rows)
    assert len(want) > 30
    assert negatives_of(df) == want
    # Many blocks of few rows and anchors.
    for name, value in {"LEAST_ROWS": 16, "BLOCK_ROWS": 64, "BLOCK_ANCHORS": 2}.items():
        monkeypatch.setattr(russian_negatives, name, value)
    assert negatives_of(df) == want


def test_hard_negatives_of_odd_rows(spark):
    rng = random.Random(5)
    good = vectors(rng, 120, 8)
    nan, inf = float("nan"), float("inf")
    bad = [(300, None, 1), (350, [nan] * 8, 1), (400, [0.1] * 7 + [inf], 1), (450, [0.2] * 8, None), (500, [None, *[0.1] * 7], 1), (550, [], 1), (600, [0.3], 1), (None, [0.2] * 8, 1), (None, [0.2] * 8, 2)]
    df = spark.createDataFrame(good + bad, VECTORS)
    assert negatives_of(df) == negatives_model(good + bad)
    assert negatives_of(df.limit(0)) == []
    # A repeated anchor gives its rows again; its copy is its first positive.
    twice = [*good, good[50]]
    assert negatives_of(spark.createDataFrame(twice, VECTORS)) == negatives_model(twice)
    assert negatives_of(spark.createDataFrame([(50, [1.0], 1)], VECTORS)) == []
    with pytest.raises(Exception, match="do not fit"):
        negatives_of(spark.createDataFrame([(50, [1e30], 1)], VECTORS))


def test_tables_give_inner_products():
    rng = np.random.default_rng(3)
    for most in (1, 100, 1 << 20):
        a, b = rng.integers(-most, most, (5, 19)), rng.integers(-most, most, (40, 19))
        planes = most.bit_length() + 1
        wide = russian_negatives.unpacked(russian_negatives.packed(a, planes))
        assert (wide[:, :19] == a).all() and not wide[:, 19:].any()
        scores = russian_negatives.Tables(wide, planes).scores(russian_negatives.packed(b, planes))
        assert (scores == b @ a.T).all()


def search_model(docs, items, top):
    words = [(i, Counter(sketch_search.terms_of(t or ""))) for i, t in docs]
    words = [(i, c) for i, c in words if c]
    n, total, df = len(words), sum(c.total() for _, c in words), Counter(t for _, c in words for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(sketch_search.terms_of(t or ""))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c in words:
            m = 100 - 50 + (50 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            scored += [(score, i)] * (score > 0)
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank, i, s) for rank, (s, i) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def search_of(docs, items, **more):
    return sorted((tuple(r) for r in sketch_search.ranked(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the quiet River holds"), (2, "漢字 mill"), (3, None), (4, ""), (5, "absent-term"), (6, "x" * 30_000), (1, "stone"), (7, "same text here"), (7, "same text here"), (None, "wheel slowly"), (8, "Über naïve über")]
    return rows, spark.createDataFrame(rows, "item_id long, text string").withColumns({"doc_id": F.lit(1), "score": F.lit("clash"), "rank": F.lit("clash")})


def test_ranked_search(docs, texts, odd, empty, items):
    rows, df = items
    for top in (5, 50):
        assert search_of(docs, df, top=top) == search_model(texts, rows, top)
    assert search_of(odd, df) == search_model([(r["doc_id"], r["text"]) for r in odd.collect()], rows, 50)
    assert search_of(empty, df) == [] and search_of(docs, df.limit(0)) == []
    # Items in several parts, and sketches so narrow that terms share coordinates.
    assert search_of(docs, df, top=5, query_bytes=10_000, width=4) == search_model(texts, rows, 5)


def test_bounds_spare_exact_scores():
    rng = random.Random(9)
    words = [f"w{int(rng.expovariate(0.01))}" for _ in range(60_000)]
    docs = [" ".join(words[k : k + 60]) for k in range(0, 60_000, 60)]
    asked = [sorted(set(docs[k].split())) for k in (3, 500, 990)]
    df = Counter(t for d in docs for t in set(d.split()))
    search = sketch_search.Search(sketch_search.Queries([0, 1, 2], asked, df, len(docs), len(words)), 5)
    for k in range(0, len(docs), 100):
        search.add(list(range(k, k + 100)), docs[k : k + 100])
    assert [r[1] for r in search.rows() if r[0] == 1][0] == 500
    assert search.rescored < 0.3 * search.bounded == 900


def plain_statistics(text):
    """Some statistics, each from the text itself."""
    words, lines = text.split(), [x for x in text.split("\n") if x]
    pairs = list(zip(words, words[1:], strict=False))
    share = lambda found, of: found / max(1, of)
    return {
        "log_chars": math.log1p(len(text)), "log_words": math.log1p(len(words)), "letters": share(sum(c.isalpha() for c in text), len(text)), "upper": share(sum(c.isupper() for c in text), len(text)),
        "word_length": share(sum(map(len, words)), len(words)), "longest_word": math.log1p(max(map(len, words), default=0)), "capitalised": share(sum(w[0].isupper() for w in words), len(words)),
        "repeated_word": share(sum(a == b for a, b in pairs), len(words)), "distinct_words": share(len(set(words)), len(words)), "top_word": share(max(Counter(words).values(), default=0), len(words)),
        "distinct_pairs": share(len(set(pairs)), len(pairs)), "repeated_lines": 1 - len(set(lines)) / len(lines) if lines else 0, "without_letters": share(sum(not any(c.isalpha() for c in w) for w in words), len(words)),
    }


def test_statistics(texts):
    some = [t or "" for _, t in texts] + ["a\n\na\nb. !! c", "\ud800 odd", "A AA AAA　漢字"]
    got = quality_trees.statistics(some)
    assert np.isfinite(got).all()
    for text, row in zip(some, got, strict=True):
        for name, want in plain_statistics(text).items():
            assert row[quality_trees.STATISTICS.index(name)] == pytest.approx(want), (name, text[:40])
    # A block gives what its texts give alone.
    assert np.allclose(got, np.concatenate([quality_trees.statistics([t]) for t in some]))


def test_flat_trees_walk_as_nested_ones():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(np.int64)
    trees = quality_trees.grow(x, y)

    def walk(tree, row, node=0):
        if node >= trees.feature.shape[1]:
            return trees.leaf[tree, node - trees.feature.shape[1]]
        return walk(tree, row, 2 * node + (2 if row[trees.feature[tree, node]] > trees.cut[tree, node] else 1))

    margins = [trees.base + sum(walk(k, row) for k in range(len(trees.leaf))) for row in x[:50]]
    assert np.allclose(trees.margin(x[:50]), margins)
    fresh = rng.normal(size=(2000, 6))
    truth = (fresh[:, 0] > 0.3) ^ (fresh[:, 3] < -0.2)
    assert ((trees.probability(fresh) > 0.5) == truth).mean() > 0.957


def test_quality_of_odd_rows(spark, docs, texts, odd, empty):
    rows = [(i, 1 if t and len(t) > 50 else 0, None) for i, t in texts] + [(None, 1, 0), (9999, 0, 0), (3, None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    trees = quality_trees.fit(docs, labels)
    got = {r["doc_id"]: r for r in quality_trees.quality(docs, trees).collect()}
    assert set(got) == {i for i, _ in texts}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert got[200]["score"] == got[201]["score"]
    want = trees.probability(quality_trees.statistics([t or "" for _, t in texts]))
    assert [got[i]["score"] for i, _ in texts] == pytest.approx(want.tolist())
    twice = quality_trees.quality(odd, trees).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in twice) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.collect())
    assert not any(r["held_out"] for r in twice if r["doc_id"] is None)
    assert quality_trees.quality(empty, trees).count() == 0
    for none in (quality_trees.fit(empty, labels), quality_trees.fit(docs, labels.limit(0)), quality_trees.fit(docs, labels.withColumn("quality", F.lit(1)))):
        scores = {r["score"] for r in quality_trees.quality(docs, none).collect()}
        assert len(scores) == 1 and 0 <= scores.pop() <= 1


def test_quality_on_the_held_out_fold(spark, sf_dir):
    # The smallest table's fold has too few rows to tell.
    docs, labels = (spark.read.parquet(f"{Path(sf_dir).parent}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_trees.quality(docs, quality_trees.fit(docs, labels)).filter("held_out").join(labels, "doc_id").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.95
