"""Log analysis: known patterns, and clusters of the lines that none knows.

Lines are reduced to signatures first: what decides similarity is the ordered list of
(letters-only form, byte length, source, important) of the tokens, and lines with one
signature meet the same cluster. Each task passes on its different signatures only; those of
a window are then placed in the order in which they came first, all windows side by side.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import Scope, keeps
from millrace.operators.aggregate import arrival, earliest, once

# Characters and texts that end a token, and the constants of similarity.
CUTTERS = r"[)!;@\[(,?}\]:^&={*]|->| - |，|【|。|（|）|】|！|；|："
SIMILAR = 0.8
SHORT = 5
MAX_PATTERNS, MAX_LENGTH, MAX_SOURCES = 64, 300, 60

_IPV4 = r"(?:\d{1,3}\.){3}\d{1,3}"
#: Different lines, and characters of them, that a task holds before it passes them on.
HELD_LINES, HELD_CHARS = 20_000, 32 << 20


def known_pattern(patterns: list[dict], scope: Scope) -> Column:
    """Name of the first pattern whose condition holds; NULL if none does. An error is no match."""
    found = [F.when(keeps(p.get("where"), scope), p["name"]) for p in patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def tokens(line: Column, most: int = MAX_LENGTH) -> Column:
    """array<string>: the words of a line's first bytes, a leading date and time left out."""
    cut = F.when(F.octet_length(line) > most, F.make_valid_utf8(F.substring(F.encode(line, "UTF-8"), 1, most).cast("string"))).otherwise(line)
    dated = (F.octet_length(cut) > 23) & (F.substring(cut, 5, 1) == "-") & (F.substring(cut, 8, 1) == "-")
    rest = F.when(dated, F.substring(cut, F.lit(24), F.length(cut))).otherwise(cut)
    return F.filter(F.transform(F.split(rest, CUTTERS), lambda w: F.trim(w)), lambda w: w != "")


def flagged(word: Column) -> Column:
    """A word with what similarity needs of it."""
    size = F.octet_length(word)
    letters = F.regexp_replace(word, "[^A-Za-z]", "")
    texty = F.length(F.regexp_replace(word, "[^A-Za-z ]", ""))
    important = (size > 10) & (F.length(F.regexp_replace(word, "[^._-]", "")) < 2) & (texty > F.lit(0.9) * size)
    source = (size > SHORT) & (word.rlike(r"^(com|java|org)\.") | word.endswith(".com") | word.rlike(_IPV4))
    return F.struct(word.alias("word"), letters.alias("letters"), size.cast("int").alias("size"), source.alias("source"), important.alias("important"))


def signature(line: Column, most: int = MAX_LENGTH) -> Column:
    """array<struct> of a line's tokens."""
    return F.transform(tokens(line, most), flagged)


def similar(tokens_: list[dict], pattern: list[dict]) -> bool:
    """True if the token counts are near and enough of the bytes that count occur in the pattern."""
    if not tokens_ or not pattern:
        return len(tokens_) == len(pattern)
    if min(len(tokens_), len(pattern)) / max(len(tokens_), len(pattern)) < SIMILAR:
        return False
    known, found, total = {t["letters"] for t in pattern}, 0, 0
    for t in tokens_:
        if t["source"] or t["size"] < SHORT:
            continue
        # An important token counts in full and twice if found, another half and once.
        total += t["size"] if t["important"] else t["size"] // 2
        if t["letters"] in known:
            found += t["size"] * (2 if t["important"] else 1)
    return total == 0 or found / total >= SIMILAR


class Placer:
    """The clusters of one window: a line joins the first similar one, opens one if there are fewer than `most`, and else is dropped."""

    def __init__(self, most: int, patterns: list[list[dict]] | None = None):
        self.most, self.patterns = most, patterns or []

    def place(self, tokens_: list[dict]) -> tuple[int, bool]:
        """Number of the line's cluster, -1 if it is dropped, and whether it opened it."""
        for k, pattern in enumerate(self.patterns):
            if similar(tokens_, pattern):
                return k, False
        if len(self.patterns) >= self.most:
            return -1, False
        self.patterns.append(tokens_)
        return len(self.patterns) - 1, True


def signature_text(words: Column) -> Column:
    """What similarity compares of a line's words, as one text: letters,size,flags of each word."""
    flags = lambda t: F.concat(F.when(t["source"], "s").otherwise(""), F.when(t["important"], "i").otherwise(""))
    return F.array_join(F.transform(words, lambda t: F.concat_ws(",", t["letters"], t["size"].cast("string"), flags(t))), ";")


def signed(text: str | None) -> list[dict]:
    """The words of a signature's text."""
    parts = (w.split(",") for w in text.split(";")) if text else ()
    return [{"letters": letters, "size": int(size), "source": "s" in flags, "important": "i" in flags} for letters, size, flags in parts]


def compared(rows: DataFrame, most_length: int = MAX_LENGTH, wanted: Column | None = None) -> DataFrame:
    """rows (with line) and signature, the text that similarity compares, and sources, the source words; NULL where wanted does not hold."""
    words = signature(F.col("line"), most_length)
    rows = once(rows, "words", words if wanted is None else F.when(wanted, words))
    return rows.withColumns({"signature": signature_text(F.col("words")), "sources": F.transform(F.filter("words", lambda t: t["source"]), lambda t: t["word"])}).drop("words")


def distinct_lines(by: list[str], place: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Task that reduces rows (by, place, line, signature, sources) to one for each `by` and signature.

    It has their number, the place and line of the first, and its source words with number
    and first place. A task holds so many different ones and then passes them on, so one
    may come several times.
    """
    keys = [*by, "signature"]

    def passed_on(found: dict[tuple, dict], schema: pa.Schema) -> pa.RecordBatch:
        at = [schema.field(c) for c in place]
        word = pa.struct([("word", pa.string()), ("count", pa.int64()), *at])
        kept = [schema.field(c) for c in (*keys, *place, "line")]
        rows = [r | {"words": [{"word": w, "count": n} | dict(zip(place, first, strict=True)) for w, (n, first) in r["words"].items()]} for r in found.values()]
        return pa.RecordBatch.from_pylist(rows, pa.schema([*kept, ("n", pa.int64()), ("words", pa.list_(word))]))

    def reduce_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, dict] = {}
        chars, schema = 0, None
        for batch in batches:
            schema = batch.schema
            table = pa.Table.from_batches([batch])
            table = table.take(pc.sort_indices(table, [(c, "ascending") for c in place])).append_column("row", pa.array(range(len(batch)), pa.int64()))
            grouped = table.select([*keys, "row"]).group_by(keys, use_threads=False).aggregate([("row", "min"), ("row", "count")])
            firsts = table.select([*keys, *place, "line"]).take(grouped["row_min"]).to_pylist()
            for r, n in zip(firsts, grouped["row_count"].to_pylist(), strict=True):
                key, at = tuple(r[c] for c in keys), tuple(r[c] for c in place)
                own = found.get(key)
                if own is None:
                    found[key] = r | {"n": n, "words": {}}
                    chars += len(r["line"] or "")
                    continue
                own["n"] += n
                if at < tuple(own[c] for c in place):
                    own.update(r)
            for r in table.filter(pc.greater(pc.list_value_length(table["sources"]), 0)).select([*keys, *place, "sources"]).to_pylist():
                words, at = found[tuple(r[c] for c in keys)]["words"], tuple(r[c] for c in place)
                for word in r["sources"]:
                    n, first = words.get(word, (0, at))
                    words[word] = (n + 1, min(first, at))
            if len(found) >= HELD_LINES or chars >= HELD_CHARS:
                yield passed_on(found, schema)
                found, chars = {}, 0
        if found:
            yield passed_on(found, schema)

    return reduce_lines


def distinct_schema(by: str, place: str) -> str:
    """Schema of the rows of distinct_lines; by and place are the schemas of these columns."""
    return f"{by}, signature string, {place}, line string, n long, words array<struct<word:string,count:bigint,{re.sub(r'(\w+) (\w+)', r'\1:\2', place)}>>"


def _signed(lines: DataFrame, start: str, most_length: int) -> DataFrame:
    """window_key, signature, seen_at, line, count, words: the lines, reduced task by task to the different signatures of a window."""
    place = [c for c in ("file_time", "path", "block", "ord") if c in lines.columns]
    rows = compared(lines.select(F.col(start).cast("string").alias("window_key"), *place, "line"), most_length)
    types = dict(rows.dtypes)
    reduced = rows.select("window_key", *place, "line", "signature", "sources").mapInArrow(distinct_lines(["window_key"], place), distinct_schema("window_key string", ", ".join(f"{c} {types[c]}" for c in place)))
    return reduced.select("window_key", "signature", arrival(reduced).alias("seen_at"), "line", F.col("n").alias("count"), "words")


def _placed(rows: DataFrame, most_patterns: int) -> DataFrame:
    """window_key, signature, count, line, cluster, opened: the signatures of rows that a cluster of their window takes.

    A window's different signatures pass through one task in order, which holds the
    patterns of one window at a time; windows are dealt over tasks.
    """
    reduced = rows.groupBy("window_key", "signature").agg(F.min("seen_at").alias("seen_at"), F.sum("count").alias("count"), F.min_by("line", "seen_at").alias("line"))
    ordered = reduced.repartition("window_key").sortWithinPartitions("window_key", "seen_at", "line").drop("seen_at")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, placer = None, Placer(most_patterns)
        for batch in batches:
            found = []
            for key, text in zip(batch.column("window_key").to_pylist(), batch.column("signature").to_pylist(), strict=True):
                if key != window:
                    window, placer = key, Placer(most_patterns)
                found.append(placer.place(signed(text)))
            clusters, opened = pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, clusters, opened], [*batch.schema.names, "cluster", "opened"])

    return ordered.mapInArrow(place, "window_key string, signature string, count long, line string, cluster int, opened boolean").filter("cluster >= 0")


def _clusters(placed: DataFrame) -> DataFrame:
    # The signature that opened a cluster came before all others of it.
    return placed.groupBy("window_key", "cluster").agg(F.sum("count").alias("count"), F.max(F.when(F.col("opened"), F.col("line"))).alias("line"))


def cluster(lines: DataFrame, start: str = "window_start", most_patterns: int = MAX_PATTERNS, most_length: int = MAX_LENGTH) -> DataFrame:
    """window_start, cluster (in order of opening), count, line (the first): unknown lines of each window in clusters."""
    found = _clusters(_placed(_signed(lines, start, most_length), most_patterns))
    return found.select(F.col("window_key").cast(dict(lines.dtypes)[start]).alias(start), "cluster", "count", "line")


def _first_words(words: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, word, count) of words (by, word, count, seen): the first most + 1 words seen in each group."""
    counted = words.groupBy(*by, "word").agg(F.sum("count").alias("count"), F.min("seen").alias("seen"))
    return earliest(counted, by, ["seen", "word"], ["word"], most + 1).drop("seen")


def source_words(lines: DataFrame, by: list[str], most_length: int = MAX_LENGTH, most: int = MAX_SOURCES) -> DataFrame:
    """Counts of the source words of each group, for the first words seen; at most most + 1 words."""
    words = lines.select(*by, arrival(lines).alias("seen"), F.explode(F.filter(signature(F.col("line"), most_length), lambda t: t["source"])).alias("t"))
    return _first_words(words.select(*by, "seen", F.col("t.word").alias("word"), F.lit(1).alias("count")), by, most)


def _cluster_sources(rows: DataFrame, placed: DataFrame, most: int = MAX_SOURCES) -> DataFrame:
    """window_key, cluster, word, count; words are counted for each signature before they meet its cluster."""
    own = rows.select("window_key", "signature", F.explode("words").alias("w"))
    seen = F.struct(*[F.col("w")[c].alias(c) for c in rows.schema["seen_at"].dataType.names])
    own = own.groupBy("window_key", "signature", F.col("w.word").alias("word")).agg(F.sum("w.count").alias("count"), F.min(seen).alias("seen"))
    return _first_words(own.join(placed.select("window_key", "signature", "cluster"), ["window_key", "signature"]), ["window_key", "cluster"], most)


def known_counts(lines: DataFrame, patterns: list[dict], scope: Scope, start: str = "window_start") -> DataFrame:
    """window_start, eventName, value, line (the first) of the known patterns."""
    named = lines.withColumn("eventName", known_pattern(patterns, scope)).filter("eventName is not null")
    return named.groupBy(start, "eventName").agg(F.count(F.lit(1)).alias("value"), F.min_by("line", arrival(lines)).alias("line"))


def known_sample() -> Column:
    """The analysis of a known pattern, of the column line."""
    return F.to_json(F.struct(F.lit(True).alias("known"), F.col("line").alias("sample")))


def analyse(lines: DataFrame, conf: dict, scope: Scope, start: str = "window_start") -> DataFrame:
    """window_start, eventName, value, analysis: a row for each known pattern, and one named __analysis for the unknown clusters of a window, each with the counts of its source words."""
    patterns = conf.get("patterns") or []
    known = known_counts(lines, patterns, scope, start)
    known = known.select(start, "eventName", F.col("value").cast("long").alias("value"), known_sample().alias("analysis"))
    rows = _signed(lines.filter(known_pattern(patterns, scope).isNull()), start, conf.get("maxLogLength") or MAX_LENGTH)
    placed = _placed(rows, conf.get("maxUnknownPatterns") or MAX_PATTERNS)
    words = _cluster_sources(rows, placed).groupBy("window_key", "cluster").agg(F.sort_array(F.collect_list(F.struct(F.col("word").alias("source"), "count"))).alias("sourceWords"))
    unknown = _clusters(placed).join(words, ["window_key", "cluster"], "left").withColumn(start, F.col("window_key").cast(dict(lines.dtypes)[start]))
    each = F.sort_array(F.collect_list(F.struct("cluster", "count", F.col("line").alias("sample"), "sourceWords")))
    unknown = unknown.groupBy(start).agg(F.sum("count").alias("value"), F.to_json(F.struct(each.alias("analyzedLogs"))).alias("analysis"))
    return known.union(unknown.select(start, F.lit("__analysis").alias("eventName"), F.col("value").cast("long").alias("value"), "analysis"))


def place_in_order(lines: list[list[dict]], most_patterns: int = MAX_PATTERNS) -> Counter:
    """Counts of clusters when lines are placed one by one; the model that cluster() is tested against."""
    placer = Placer(most_patterns)
    counts = Counter(placer.place(line)[0] for line in lines)
    del counts[-1]
    return counts
