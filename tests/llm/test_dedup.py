"""Exact and near dedup, shards and repeat removal against brute force."""

import functools
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import chunk_recipes, feistel_shards, repeat_groups, repeat_intervals, vantage_simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def exact_model(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t in rows:
        body = (t or "").translate(LOWER)
        keep = max((x for x in groups[body] if x is not None), default=None)
        out.append((i, keep, len(groups[body]), i == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


def exact_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_exact_groups(docs, texts, odd, empty):
    assert exact_rows(chunk_recipes.exact_groups(docs)) == exact_model(texts)
    assert exact_rows(chunk_recipes.exact_groups(odd)) == exact_model([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert chunk_recipes.exact_groups(empty).count() == 0


def test_exact_groups_when_identifiers_collide(docs, texts, odd):
    weak = lambda c: (F.length(c) % 3).cast("long")
    assert exact_rows(chunk_recipes.exact_groups(docs, weak)) == exact_model(texts)
    assert exact_rows(chunk_recipes.exact_groups(odd, weak)) == exact_model([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_chunks_join_to_the_text(docs, texts):
    joined = docs.select("doc_id", F.array_join(chunk_recipes.chunks(F.coalesce("text", F.lit("")), 20, 60), "").alias("t")).collect()
    assert {r["doc_id"]: r["t"] for r in joined} == {i: t or "" for i, t in texts}
    sizes = docs.select(F.explode(F.transform(chunk_recipes.chunks(F.col("text"), 20, 60), lambda c: F.length(c)))).collect()
    assert max(r[0] for r in sizes) <= 60


def test_cuts_follow_content_in_any_script(spark):
    rng = random.Random(12)
    scripts = {"cjk": "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6000)), "letters": "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(6000)), "words": " ".join("mühle" for _ in range(1000)), "ends": "川の石。" * 1500}
    for name, text in scripts.items():
        rows = spark.createDataFrame([(0, text), (1, "zz" + text)], "doc_id long, text string").select("doc_id", chunk_recipes.chunks(F.col("text"), 64, 512).alias("c")).collect()
        first, second = (r["c"] for r in sorted(rows))
        assert "".join(first) == text and "".join(second) == "zz" + text
        assert max(map(len, first)) < 512 and len(set(first) & set(second)) > 0.9 * len(set(first)), name


def test_rows_of_hot_groups_are_dealt(spark):
    from millrace.llm.common import each_copy, joined_back

    rows = spark.range(6000).select((F.col("id") % 3000).alias("k"), F.col("id")).union(spark.range(4000, numPartitions=8).select(F.lit(-1).alias("k"), F.col("id"))).repartition(8)
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    found = joined_back(rows, groups, ["k"], "n", 10_000)
    assert found.columns == ["k", "id", "n", "top"]
    assert sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in rows.join(groups, "k").collect())
    copies = each_copy(spark.createDataFrame([("a", 1), ("b", 10_000), ("c", 4096), ("d", 4097)], "x string, n long"), "n").groupBy("x").agg(F.count("copy").alias("rows"), F.countDistinct("copy").alias("all"), F.max("copy").alias("last"))
    assert sorted(map(tuple, copies.collect())) == [("a", 1, 1, 0), ("b", 10_000, 10_000, 9999), ("c", 4096, 4096, 4095), ("d", 4097, 4097, 4096)]


def test_drop_exact_copies(docs, texts, empty):
    kept = chunk_recipes.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, keep, _, stays, _ in exact_model(texts) if stays)
    assert chunk_recipes.drop_exact_copies(empty).count() == 0


def some_alone(spark, odd):
    """odd with texts that nothing else has, under ids whose other rows are copies."""
    alone = [(None, "a quiet mill that no other row speaks of"), (2, "the wheel turns slowly past old gates")]
    return odd.union(spark.createDataFrame([(i, t, None, None, None) for i, t in alone], odd.schema))


def id_texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_drop_exact_copies_by_row(spark, odd):
    rows = some_alone(spark, odd)
    want = [(1, "another"), (2, "SAME text here"), (2, "the wheel turns slowly past old gates"), (3, None), (3, None), (None, "a quiet mill that no other row speaks of")]
    assert id_texts(chunk_recipes.drop_exact_copies(odd)) == sorted([want[0], want[1], *want[3:5]], key=repr)
    assert id_texts(chunk_recipes.drop_exact_copies(rows)) == sorted(want, key=repr)


def test_keep_one_of_each_by_row(spark, odd):
    same = [(1, "same text here"), (1, "same text here"), (1, "another"), (3, None), (3, None)]
    alone = [(2, "the wheel turns slowly past old gates"), (None, "a quiet mill that no other row speaks of")]
    assert id_texts(vantage_simhash.keep_one_of_each(odd)) == sorted(same, key=repr)
    assert id_texts(vantage_simhash.keep_one_of_each(some_alone(spark, odd))) == sorted(same + alone, key=repr)


def test_feistel_is_a_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        a = int(np.ceil(np.sqrt(n)))
        b = -(-n // a)
        cols = [F.lit(x).cast("long") for x in (n, a, b)]
        df = spark.range(n).select("id", feistel_shards.walked(F.col("id"), *cols, 5).alias("p"))
        df = df.withColumn("back", feistel_shards.walked(F.col("p"), *cols, 5, feistel_shards.inverse_feistel))
        rows = df.collect()
        assert sorted(r["p"] for r in rows) == list(range(n))
        assert all(r["back"] == r["id"] for r in rows)


def test_shards(docs, texts, odd, empty):
    import zlib

    found = feistel_shards.shard_rows(docs).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(len(slots[k]) for k in range(16)) <= 1
    again = feistel_shards.shard_rows(docs.repartition(7)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    got, given = feistel_shards.shard_rows(odd).collect(), [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in given), key=repr)
    assert len({r["shard"] for r in got}) == 8 and {r["slot"] for r in got} == {0} and {r["law"] for r in got} == {"rows"}
    assert feistel_shards.shard_rows(empty).count() == 0


def fingerprint_model(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components_model(points, radius):
    parent = {p: p for p in points}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    points = sorted(points)
    for k, a in enumerate(points):
        for b in points[:k]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_near_duplicates(docs, texts, odd, empty):
    fps = {i: fingerprint_model(t) for i, t in texts}
    roots = components_model(set(fps.values()), 4)
    smallest = {}
    for i, f in fps.items():
        smallest[roots[f]] = min(i, smallest.get(roots[f], i))
    found = vantage_simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {i: (f"{f:016x}", smallest[roots[f]]) for i, f in fps.items()}
    kept = vantage_simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(smallest.values())
    groups = [(None, 1), (1, 1), (1, 1), (1, 1), (2, 1), (None, 3), (3, 3), (3, 3)]
    assert sorted(((r["doc_id"], r["component_id"]) for r in vantage_simhash.near_duplicates(odd).collect()), key=repr) == sorted(groups, key=repr)
    assert vantage_simhash.near_duplicates(empty).count() == 0


def test_links_over_many_shards(spark):
    rng = random.Random(3)
    points = {rng.getrandbits(64) for _ in range(200)}
    for p in list(points)[:40]:
        for _ in range(15):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            points.add(q)
    signed = lambda p: p - (p >> 63 << 64)
    df = spark.createDataFrame([(signed(p),) for p in points], "fp long").repartition(4)
    found = {r["node"]: r["root"] for r in vantage_simhash.components(vantage_simhash.near_links(df, 4, 32)).collect()}
    groups = defaultdict(set)
    for p, root in components_model(points, 4).items():
        groups[root].add(signed(p))
    assert found == {p: min(g) for g in groups.values() for p in g if p != min(g)}


def repeats_model(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeats(df, **options):
    rows = repeat_intervals.remove_repeats(df, **options).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}


def test_remove_repeats(docs, texts, odd, empty, monkeypatch):
    want = repeats_model(texts)
    assert any(w[1] for w in want.values())
    assert repeats(docs) == want
    # Parts that are split at once to one string, after some ranges, and with names of parts joined by a shuffle.
    assert repeats(docs, hot=0) == want
    assert repeats(docs, hot=3) == want
    monkeypatch.setattr(repeat_intervals, "FEW_PARTS", 0)
    assert repeats(docs, hot=1) == want
    rows = [tuple(r)[:4] for r in repeat_intervals.remove_repeats(odd).collect()]
    assert sorted(rows, key=repr) == sorted(((r["doc_id"], len(r["text"] or ""), 0, 0) for r in odd.collect()), key=repr)
    assert repeat_intervals.remove_repeats(empty).count() == 0


def test_repeats_under_null_and_repeated_ids(spark):
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, a, b = word(150), word(60), word(60)
    rows = [(None, a + shared), (None, b + b + shared), (5, shared), (5, shared), (5, word(40) + shared), (-(1 << 63), word(30)), (7, b + "x" * 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeat_intervals.remove_repeats(df).collect()), key=repr)
    # The null row that has it at offset 60 is first; equal offsets of one id do not meet.
    want = [(None, 210, 0, 0), (None, 270, 150, 1), (5, 150, 150, 1), (5, 150, 150, 1), (5, 190, 150, 1), (-(1 << 63), 30, 0, 0), (7, 190, 129, 1)]
    assert found == sorted(want, key=repr)


def test_repeats_in_long_texts(spark):
    """Texts above one segment, against the places where they were planted."""
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 2_600_000, dtype=np.uint8).tobytes().decode()
    piece = body[1_048_500:1_048_900]
    rows = [(1, body), (2, "new " * 10 + piece + body[2_000_000:2_000_150])]
    found = {r["doc_id"]: r for r in repeat_intervals.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (found[1]["n_bytes"], found[1]["n_removed"]) == (2_600_000, 0)
    assert (found[2]["n_removed"], found[2]["n_spans"]) == (550, 1)


def test_intervals():
    # suffixes of banana: a ana anana banana na nana
    assert sorted(repeat_intervals.intervals(np.array([-1, 1, 3, 0, 0, 2]))) == [(0, 0, 5), (1, 0, 2), (2, 4, 5), (3, 1, 2)]


def test_repeats_of_random_texts(spark):
    rng = random.Random(4)
    pieces = ["".join(rng.choice("ab é") for _ in range(rng.randint(50, 300))) for _ in range(5)]
    rows = [(i, "".join(rng.choice(pieces)[rng.randint(0, 60) :] for _ in range(rng.randint(0, 4))) + "z" * rng.choice([0, 0, 150])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert repeats(df) == repeats_model(rows)
    for hot in (0, 2, 10):
        assert repeats(df, hot=hot) == repeats_model(rows)


def groups_model(rows):
    """Sets of (string, its places): repeated 100-byte strings, made one with the next where both have the same places."""
    raws = [(i, (t or "").encode()) for i, t in dict.fromkeys(rows)]
    places = defaultdict(list)
    for r, (_, raw) in enumerate(raws):
        for p in range(len(raw) - 99):
            places[raw[p : p + 100]].append((r, p))
    places = {k: set(some) for k, some in places.items() if len(some) > 1}
    at = {p: k for k, some in places.items() for p in some}

    @functools.cache
    def follows(one, other):
        return len(places[one]) == len(places[other]) and places[other] == {(r, p + 1) for r, p in places[one]}

    goes_on = lambda r, p: (r, p + 1) in at and follows(at[r, p], at[r, p + 1])
    out = defaultdict(list)
    for r, p in at:
        if (r, p - 1) in at and goes_on(r, p - 1):
            continue
        q = p
        while goes_on(r, q):
            q += 1
        out[raws[r][1][p : q + 100]].append((raws[r][0], p))
    return {s: sorted(some, key=repr) for s, some in out.items()}


def repeat_group_rows(df, rows, **options):
    raw = {(i, len((t or "").encode())): (t or "").encode() for i, t in rows}
    found, strings = defaultdict(list), {}
    for r in repeat_groups.maximal_repeats(df, **options).collect():
        found[r["group_id"]].append((r["doc_id"], r["start"], r["length"], r["copies"]))
    out = {}
    for group, some in found.items():
        assert {(x[2], x[3]) for x in some} == {(some[0][2], len(some))}
        doc, start, length, _ = some[0]
        own = [x for (i, _), x in raw.items() if i == doc]
        strings[group] = next(x for x in own if len(x) >= start + length)[start : start + length]
        assert strings[group] not in out
        out[strings[group]] = sorted(((x[0], x[1]) for x in some), key=repr)
    return out


def test_maximal_repeats(spark, docs, texts, odd, empty, monkeypatch):
    rng = random.Random(9)
    pieces = ["".join(rng.choice("ab é") for _ in range(rng.randint(60, 400))) for _ in range(6)]
    rows = [(i, "".join(rng.choice(pieces)[rng.randint(0, 60) :][: rng.randint(90, 400)] for _ in range(rng.randint(0, 4))) + "z" * rng.choice([0, 0, 150])) for i in range(40)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").repartition(4)
    want = groups_model(rows)
    assert len(want) > 20 and max(map(len, want)) > 150 and max(map(len, want.values())) > 5
    assert repeat_group_rows(df, rows) == want
    # By parts of at most two contexts, and by parts of one string.
    for hot in (0, 2):
        assert repeat_group_rows(df, rows, hot=hot) == want
    assert repeat_group_rows(docs, texts) == groups_model(texts)
    assert repeat_groups.maximal_repeats(odd).count() == repeat_groups.maximal_repeats(empty).count() == 0


def test_maximal_repeats_of_one_text_under_null_and_equal_ids(spark):
    text = "".join(random.Random(5).choices("abcdefgh ", k=150))
    rows = [(None, text), (None, text), (None, "x" + text), (-(1 << 63), text), (5, text), (5, "yy" + text), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((tuple(r)[1:] for r in repeat_groups.maximal_repeats(df).collect()), key=repr)
    assert found == sorted([(150, 5, None, 0), (150, 5, None, 1), (150, 5, -(1 << 63), 0), (150, 5, 5, 0), (150, 5, 5, 2)], key=repr)
