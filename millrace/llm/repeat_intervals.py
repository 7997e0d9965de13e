"""Removal of repeated byte strings by common-prefix intervals of a sparse suffix array.

A string of LENGTH bytes that also starts earlier makes its bytes go. Every such string
holds an anchor: the least K-gram hash among its K-grams, leftmost of equals. Equal
strings have the same anchor at the same place, so suffixes need to be compared only
where they start at anchors with the same K-gram, about one byte in 35:

1. Anchors are hashed where texts are read, and K-grams that occur once are let go.
2. The other anchors travel with the bytes of the strings they answer for.
3. Suffixes of one K-gram are sorted; a stack scan over their common prefixes gives all
   intervals of the enhanced suffix array. The members of an interval that also share
   enough bytes to the left repeat a string of LENGTH; all but the first of them lose it.
   An interval whose members agree further to the left is not a maximal repeat by
   itself; the same scan over the reversed left sides finds how far it extends.

Copies within a batch are settled there. A K-gram with more than HOT occurrences is split: its strings are dealt by how far
they reach to the left of it, in ranges of LEVELS places, and each part is known by all bytes that the strings of a range
have in common. Two equal strings are in one part, so the same scan over each part finds all; a part that is still too
large is split by the next, narrower range, down to parts of one string, of which the first place is a minimum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import durable, joined_back, texts

LENGTH = 100
K = 32
WINDOW = LENGTH - K + 1
SEGMENT = 1 << 20
#: Contexts that one scan takes; a K-gram or part with more is split by the next range of LEVELS.
HOT = 100_000
LEVELS = (23, 8, 1)
#: Names of split parts that are broadcast; more of them are joined by a shuffle.
FEW_PARTS = 1 << 20
#: What a null doc_id is where places are ordered.
NO_ID = -(1 << 63)
#: Bytes of text for each bucket of K-grams and for each task of a shuffle.
BUCKET_BYTES, TASK_BYTES = 8 << 20, 64 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_POSITION = np.uint64((1 << 26) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(_BASE, 2 * SEGMENT + 2 * LENGTH)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), 2 * SEGMENT + 2 * LENGTH)


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n bytes in a row."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)])])
    h = (total[n:] - total[:-n]) * _DOWN[: len(data) - n + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(raws: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, text, anchor, first, last) of each run of string starts that share an anchor; some texts at a time."""
    some: list[tuple[int, int, bytes]] = []
    size = 0
    for t, raw in enumerate(raws):
        for at in range(0, max(0, len(raw) - LENGTH + 1), SEGMENT):
            some.append((t, at, raw[at : at + SEGMENT + LENGTH - 1]))
            size += len(some[-1][2])
            if size >= SEGMENT:
                yield _anchors(some)
                some, size = [], 0
    if some:
        yield _anchors(some)


def _anchors(some: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(raw for _, _, raw in some), np.uint8)
    sizes = np.array([len(raw) for _, _, raw in some])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = rolling(data, K)
    least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while 2 * span <= WINDOW:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := WINDOW - span:
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & _POSITION).astype(np.int64)
    part = np.repeat(np.arange(len(some)), sizes)[: len(anchor)]
    ok = np.arange(len(anchor)) + LENGTH <= (begin + sizes)[part]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
    first = np.nonzero(ok & new)[0]
    stop = np.nonzero(ok & np.append(new[1:] | ~ok[1:], True))[0]
    part, at = part[first], anchor[first]
    shift = np.array([at for _, at, _ in some])[part] - begin[part]
    return h[at], np.array([t for t, _, _ in some])[part], at + shift, first + shift, stop + shift


def _same(groups: np.ndarray) -> np.ndarray:
    """Where a sorted array's groups start."""
    return np.concatenate([[0], np.nonzero(groups[1:] != groups[:-1])[0] + 1]) if len(groups) else np.zeros(0, np.int64)


def tasks_for(docs: DataFrame, total: int) -> int:
    """Shuffle partitions, as many more as the texts need for TASK_BYTES in each."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))


def ask(homes: np.ndarray, raws: list[bytes], buckets: int) -> list[tuple]:
    """Rows (bucket, settled, hash, count, home, anchor), each column's values in one binary.

    A batch asks once for each K-gram. The other occurrences of one that it has twice are
    known to repeat; they are settled, and carry neither hash nor count.
    """
    found = [x[:3] for x in anchors(raws)]
    if not found:
        return []
    h, text, at = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(h, kind="stable")
    h, doc, at = h[order], homes[text[order]], at[order]
    start = _same(h)
    count = np.diff(np.append(start, len(h)))
    settled = np.ones(len(h), bool)
    settled[start] = False
    bucket = np.where(settled, pd.util.hash_array(doc), h % np.uint64(buckets)) % np.uint64(buckets)
    count = np.repeat(count, count)
    order = np.lexsort((settled, bucket))
    bucket, settled, h, count, doc, at = (c[order] for c in (bucket.astype(np.int64), settled, h, count, doc, at))
    edge = np.append(_same(bucket * 2 + settled), len(order))
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        asks = (b"", b"") if settled[a] else (h[a:b].tobytes(), count[a:b].astype(np.int64).tobytes())
        out.append((int(bucket[a]), bool(settled[a]), *asks, doc[a:b].astype(np.int64).tobytes(), at[a:b].astype(np.int64).tobytes()))
    return out


def answer(group: pd.DataFrame, hot: int) -> pd.DataFrame:
    """(home, known, is_hot): anchors whose K-gram occurs again; and, is_hot, the K-grams that occur more than hot times."""
    out = []
    for settled, part in group.groupby("settled"):
        h, count, doc, at = (np.frombuffer(b"".join(part[c]), kind) for c, kind in (("hash", np.uint64), ("n", np.int64), ("homes", np.int64), ("at", np.int64)))
        if settled:
            out.append(pd.DataFrame({"home": doc, "known": at, "is_hot": False}))
            continue
        order = np.argsort(h, kind="stable")
        start = _same(h[order])
        total = np.add.reduceat(count[order], start)
        again = np.repeat(total > 1, np.diff(np.append(start, len(h))))
        out.append(pd.DataFrame({"home": doc[order][again], "known": at[order][again], "is_hot": False}))
        out.append(pd.DataFrame({"home": 0, "known": h[order][start][total > hot].view(np.int64), "is_hot": True}))
    return pd.concat(out)


def intervals(lcp: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of every interval of sorted suffixes; lcp[i]: of i - 1 and i, lcp[0] = -1."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now = int(lcp[i]) if i < len(lcp) else -1
        left = i - 1
        while stack and stack[-1][0] > now:
            depth, left = stack.pop()
            yield depth, left, i - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, left))


def matrix(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of bytes filled up with zeros, and their lengths."""
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width), np.array([len(s) for s in strings])


def common(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Lengths of the common prefixes of strings in pairs."""
    width = max(1, *map(len, a), *map(len, b))
    (x, nx), (y, ny) = matrix(a, width), matrix(b, width)
    differ = x != y
    return np.minimum(np.where(differ.any(1), differ.argmax(1), width), np.minimum(nx, ny))


def rows_as_keys(m: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(m).view(f"V{m.shape[1]}").ravel() if m.shape[1] else np.zeros(len(m), "V1")


def extents(near: np.ndarray, near_n: np.ndarray, far: np.ndarray, far_n: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each member, the longest prefix of near that it shares with an earlier one while far agrees on the rest of LENGTH; 0 if none.

    near, far: the two sides of the anchors as rows; place: the order of the members.
    """
    order = np.lexsort((near_n, np.unique(rows_as_keys(near), return_inverse=True)[1].ravel()))
    m, n = near[order], near_n[order]
    differ = m[1:] != m[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), near.shape[1])
    lcp = np.concatenate([[-1], np.minimum(lcp, np.minimum(n[1:], n[:-1]))])
    best = np.zeros(len(order), np.int64)
    for depth, a, b in intervals(lcp):
        need = LENGTH - depth
        if need > far.shape[1] or b == a:
            continue
        candidates = order[a : b + 1]
        candidates = candidates[far_n[candidates] >= need]
        # What a longer prefix has settled for all needs no other look.
        if len(candidates) < 2 or np.count_nonzero(best[candidates] < depth) < 1:
            continue
        side = rows_as_keys(far[candidates][:, : max(0, need)])
        kind = np.zeros(len(candidates), np.int64) if need <= 0 or (side == side[0]).all() else np.unique(side, return_inverse=True)[1].ravel()
        first = np.full(kind.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, kind, place[candidates])
        later = candidates[place[candidates] > first[kind]]
        best[later] = np.maximum(best[later], depth)
    return best


def settle(group: pd.DataFrame) -> pd.DataFrame:
    """Spans (doc_id, key, start, stop) that a bucket's repeats take from all but their first members.

    group: hash, doc_id, key, first, delta (anchor less first), bytes.
    """
    group = group.sort_values(["hash", "doc_id", "first"], kind="stable", ignore_index=True)
    hashes, doc, key, first, delta = (group[c].to_numpy() for c in ("hash", "doc_id", "key", "first", "delta"))
    data = group["bytes"].to_list()
    left = [x[:d][::-1] for x, d in zip(data, delta.tolist(), strict=True)]
    right = [x[d:] for x, d in zip(data, delta.tolist(), strict=True)]
    anchor, start = first + delta, _same(hashes)
    size = np.diff(np.append(start, len(hashes)))
    down, up = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
    # Two suffixes have one interval: their common prefix.
    two = start[size == 2]
    two = two[(doc[two] != doc[two + 1]) | (anchor[two] != anchor[two + 1])]
    for at in range(0, len(two), 4096):
        a = two[at : at + 4096]
        l, r = (common([side[i] for i in a.tolist()], [side[i + 1] for i in a.tolist()]) for side in (left, right))
        enough = l + r >= LENGTH
        down[a[enough] + 1], up[a[enough] + 1] = l[enough], r[enough]
    for a, b in zip(start[size > 2].tolist(), (start + size)[size > 2].tolist(), strict=True):
        (lm, ln), (rm, rn) = matrix(left[a:b], max(1, *map(len, left[a:b]))), matrix(right[a:b], max(map(len, right[a:b])))
        # Equal places (a repeated row) are not before each other.
        place = np.cumsum(np.concatenate([[False], (doc[a + 1 : b] != doc[a : b - 1]) | (anchor[a + 1 : b] != anchor[a : b - 1])]))
        up[a:b] = extents(rm, rn, lm, ln, place)
        if up[a:b].any():
            down[a:b] = extents(lm, ln, rm, rn, place)
    hit = np.nonzero(up)[0]
    return pd.DataFrame({"doc_id": doc[hit], "key": key[hit], "start": anchor[hit] - down[hit], "stop": anchor[hit] + up[hit]})


def contexts(ids: np.ndarray, keys: np.ndarray, raws: list[bytes], known: list[np.ndarray]) -> tuple[list[tuple], list[tuple]]:
    """What the known anchors of some texts send: contexts (hash, doc_id, key, first, delta, bytes), and spans settled here."""
    seen: dict[tuple, tuple] = {}
    spans = []
    order = sorted(range(len(raws)), key=lambda i: int(ids[i]))
    for h, text, at, first, last in anchors([raws[i] for i in order]):
        edge = np.append(_same(text), len(text)).tolist()
        for begin, end in zip(edge[:-1], edge[1:], strict=True):
            t = order[text[begin]]
            own = begin + np.nonzero(np.isin(at[begin:end], known[t]))[0]
            raw, doc, key = raws[t], int(ids[t]), int(keys[t])
            for i, f, s, x in zip(at[own].tolist(), first[own].tolist(), last[own].tolist(), h[own].view(np.int64).tolist(), strict=True):
                context = raw[f : s + LENGTH]
                sent = seen.setdefault((x, i - f, context), (x, doc, key, f, i - f, context))
                if sent[1] != doc or sent[3] != f:
                    spans.append((doc, key, f, s + LENGTH))
    return list(seen.values()), whole_spans(spans)


def whole_spans(spans: list[tuple]) -> list[tuple]:
    """Spans (doc_id, key, start, stop) with those of a text that touch made one."""
    of_doc: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for doc, key, a, b in spans:
        of_doc.setdefault((doc, key), []).append((a, b))
    return [(doc, key, a, b) for (doc, key), some in of_doc.items() for a, b in merged(some)]


def pieces(some: list[tuple], width: int) -> tuple[list[tuple], list[tuple]]:
    """Contexts cut for a split, and the spans of pieces that an earlier context among them has too.

    some: (doc_id, key, first, delta, bytes). A piece holds the strings that start a to a + width - 1 bytes before the
    anchor, a a multiple of width; its hash is that of the bytes which all strings of that range share.
    """
    seen: dict[tuple, tuple] = {}
    spans = []
    for doc, key, first, delta, data in sorted(some):
        low = delta - (len(data) - LENGTH)
        for a in range(low // width * width, delta + 1, width):
            top, bottom = min(a + width - 1, delta), max(a, low)
            piece, start = data[delta - top : delta - bottom + LENGTH], first + delta - top
            shared = xxhash.xxh64_intdigest(data[delta - a : delta - (a + width - 1) + LENGTH], seed=a)
            shared -= (shared >> 63) << 64
            sent = seen.setdefault((shared, top, piece), (shared, doc, key, start, top, piece))
            if sent[1] != doc or sent[3] != start:
                spans.append((doc, key, start, start + len(piece)))
    return list(seen.values()), whole_spans(spans)


SENT = "kind long, bucket long, hash long, doc_id long, key long, first long, delta long, bytes binary"


def sent_rows(some: list[tuple], spans: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of SENT: contexts (kind 0), and spans (kind 2; first and delta are their ends)."""
    table = [(0, x[0] % buckets, *x) for x in some] + [(2, doc % buckets, 0, doc, key, a, b, b"") for doc, key, a, b in spans]
    for at in range(0, len(table), 20_000):
        part = table[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], kind) for k, kind in enumerate((*[pa.int64()] * 7, pa.binary()))], [c.split()[0] for c in SENT.split(", ")])


def finish(group: pd.DataFrame) -> pd.DataFrame:
    done = group[group["kind"] == 2]
    parts = [settle(group[group["kind"] == 0]), pd.DataFrame({"doc_id": done["doc_id"], "key": done["key"], "start": done["first"], "stop": done["delta"]})]
    return pd.concat([p for p in parts if len(p)] or parts[:1]).astype("int64")


def scanned(sent: DataFrame, tasks: int) -> DataFrame:
    """(doc_id, key, start, stop): the spans of rows of SENT, parts scanned by buckets."""
    return sent.select(*(c.split()[0] for c in SENT.split(", "))).repartition(tasks, "bucket").groupBy("bucket").applyInPandas(finish, "doc_id long, key long, start long, stop long")


def sized(parts: DataFrame, most: int) -> DataFrame:
    """Contexts with large: whether over `most` of them have their hash. parts: a durable table."""
    counts = parts.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    large = durable(counts.filter(F.col("n") > most))
    if large.count() <= FEW_PARTS:
        return parts.join(F.broadcast(large), "hash", "left").withColumn("large", F.col("n").isNotNull())
    return joined_back(parts, counts, ["hash"], "n", parts.count()).withColumn("large", F.col("n") > most)


def split_spans(parts: DataFrame, most: int, buckets: int, tasks: int) -> DataFrame:
    """Spans of the contexts of hot K-grams, by parts of at most `most` contexts each."""

    def cut(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                some = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "first", "delta", "bytes")), strict=True)
                yield from sent_rows(*pieces(list(some), width), buckets)

        return run

    ends = lambda df: df.select("doc_id", "key", F.col("first").alias("start"), F.col("delta").alias("stop"))
    found = None
    for width in LEVELS:
        cuts = durable(parts.mapInArrow(cut(width), SENT))
        spans, parts = ends(cuts.filter("kind = 2")), cuts.filter("kind = 0")
        found = found.unionByName(spans) if found else spans
        if width > 1:
            parts = sized(parts, most)
            found = found.unionByName(scanned(parts.filter("not large"), tasks))
            parts = parts.filter("large")
    # Parts of one string: all members are equal, and every one after the first place goes.
    groups = parts.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "first")).alias("lead"))
    strings = joined_back(parts, groups.filter("n > 1"), ["bytes"], "n", parts.count())
    later = strings.filter((F.col("doc_id") != F.col("lead.doc_id")) | (F.col("first") != F.col("lead.first")))
    return found.unionByName(later.select("doc_id", "key", F.col("first").alias("start"), (F.col("first") + LENGTH).alias("stop")))


def home(place: str) -> F.Column:
    """Where a row's finds are sent: its doc_id; rows without one part by their texts."""
    return F.when(F.col(place) == NO_ID, F.col("key")).otherwise(F.col(place))


def _spans(docs: DataFrame, hot: int, total: int) -> DataFrame:
    """(doc_id, key, start, stop, home) of the bytes that go; total: the bytes of all texts."""
    buckets, tasks = max(128, total // BUCKET_BYTES), tasks_for(docs, total)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ask(batch.column("home").to_numpy(), [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()], buckets)
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["bucket", "settled", "hash", "n", "homes", "at"])

    asked = docs.mapInArrow(find, "bucket long, settled boolean, hash binary, n binary, homes binary, at binary")
    answers = durable(asked.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(lambda g: answer(g, hot), "home long, known long, is_hot boolean"))
    of_doc = answers.filter("not is_hot").repartition(tasks, "home").groupBy("home").agg(F.collect_set("known").alias("known"))
    rows = docs.repartition(tasks, "home").join(of_doc, "home")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            raws = [t.encode("utf-8", "replace") for t in whole.column("text").to_pylist()]
            yield from sent_rows(*contexts(whole.column("place").to_numpy(), whole.column("key").to_numpy(), raws, [np.array(k, np.int64) for k in whole.column("known").to_pylist()]), buckets)

    sent = rows.mapInArrow(send, SENT)
    if answers.filter("is_hot").isEmpty():
        return scanned(sent, tasks).withColumn("home", home("doc_id"))
    sent = durable(sent)
    parts = sized(sent.filter("kind = 0"), hot)
    small = scanned(parts.filter("not large").unionByName(sent.filter("kind = 2"), allowMissingColumns=True), tasks)
    return small.unionByName(split_spans(parts.filter("large"), hot, buckets, tasks)).withColumn("home", home("doc_id"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary): one row for each row of docs.

    A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a text
    with a smaller doc_id, or in the same one further ahead. Strings are judged on the
    input and never cross texts. A null text is empty; a text below LENGTH bytes keeps
    all. A null doc_id counts as the smallest. Rows that repeat a doc_id are the same
    place: strings at the same offset of them do not remove each other. Other columns
    are ignored.
    """
    docs = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("place"), F.xxhash64("text").alias("key"), "text").withColumn("home", home("place"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    spans = _spans(docs, hot, total).groupBy("home").agg(F.collect_list(F.struct("doc_id", "key", "start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for doc_id, place, key, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "key", "text", "spans")), strict=True):
                    raw = text.encode("utf-8", "replace")
                    runs = merged([(s["start"], s["stop"]) for s in spans or () if (s["doc_id"], s["key"]) == (place, key)])
                    edges = [0, *(x for run in runs for x in run), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                    rows.append((doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
                kinds = (*[pa.int64()] * 4, pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.repartition(tasks_for(docs, total), "home").join(spans, "home", "left").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
