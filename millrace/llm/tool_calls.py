"""Tool-call linking for chat data, in DataFrame operations only.

Calls meet their results by a hash join on conversation and call id; both sides are
made unique first, so the join cannot multiply rows. The order is that of the forest
in which a call follows its parent call: its level is found by pointer doubling over ids
alone, which takes as many joins as the logarithm of the longest chain, and positions come
from one sort by ranges; neither gathers a conversation. Arguments are checked against
the schema of their tool, and each link is written as one canonical JSON text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import durable, joined_back

#: Tools that may be broadcast; more are joined without it.
BROADCAST_TOOLS = 10_000
#: Fixed value: the schema of a tool's parameters.
PARAMS = "array<struct<key:string,type:string,required:boolean,choices:array<string>>>"
#: Digits before the point, or zeros after it, up to which a number is written without an exponent.
PLAIN_DIGITS, PLAIN_ZEROS = 21, 6

#: A number within variants is a string that starts with this mark, so that none of its digits is lost.
_MARK = "\u0001"
_MARKED = r"^\x01-?[0-9]"


def json_string(text: Column) -> Column:
    """A string as a JSON string; null as null."""
    quoted = F.to_json(F.struct(text.cast("string").alias("s")))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.substring(quoted, F.lit(6), F.length(quoted) - 6))


def marked(text: Column) -> Column:
    """JSON text as a variant whose numbers are marked strings; null if it is no JSON."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\u0002")), F.lit('\\"'), F.lit("\u0003"))
    # A mark that a string holds is doubled.
    plain = F.replace(plain, F.lit("\\u0001"), F.lit("\\u0001\\u0001"))
    plain = F.regexp_replace(plain, r'("[^"]*+")|(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)', "$1\u0001$2\u0001")
    plain = F.regexp_replace(F.replace(plain, F.lit("\u0001\u0001"), F.lit("")), "\u0001([^\u0001]+)\u0001", '"\\\\u0001$1"')
    plain = F.replace(F.replace(plain, F.lit("\u0003"), F.lit('\\"')), F.lit("\u0002"), F.lit("\\\\"))
    return F.when(F.try_parse_json(text).isNotNull(), F.try_parse_json(plain))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number(text: Column) -> Column:
    """The one form of a JSON number: all its digits, no needless zeros or signs; exponents only for very large and very small ones."""

    def read(t: Column) -> Column:
        part = lambda k: F.regexp_extract(t, r"^-?([0-9]+)(?:\.([0-9]+))?(?:[eE]\+?(-?[0-9]+))?$", k)
        power = F.when(part(3) == "", F.lit(0)).otherwise(part(3).try_cast("int"))
        return F.struct(t.alias("text"), part(1).alias("whole"), F.concat(part(1), part(2)).alias("written"), power.alias("power"))

    def point(n: Column) -> Column:
        digits = F.regexp_replace(n["written"], "^0+", "")
        # Digits before the point; zero or less: zeros after it.
        before = F.length(n["whole"]) + n["power"] - F.length(n["written"]) + F.length(digits)
        return F.struct(n["text"].alias("text"), before.alias("point"), F.regexp_replace(digits, "0+$", "").alias("digits"))

    def write(n: Column) -> Column:
        digits, at, size = n["digits"], n["point"], F.length(n["digits"])
        fraction = F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise("")
        form = (
            F.when((at >= size) & (at <= PLAIN_DIGITS), F.rpad(digits, at, "0"))
            .when((at > 0) & (at < size), F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, size)))
            .when((at <= 0) & (at > -PLAIN_ZEROS), F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), digits))
            .otherwise(F.concat(F.substring(digits, 1, 1), fraction, F.lit("e"), (at - 1).cast("string")))
        )
        sign = F.when(n["text"].startswith("-"), F.lit("-")).otherwise("")
        # An exponent beyond 32 bits is left as it is.
        return F.when(at.isNull(), n["text"]).when(digits == "", F.lit("0")).otherwise(F.concat(sign, form))

    return bound(bound(bound(text, read), point), write)


def canonical(value: Column) -> Column:
    """A marked variant as JSON text: keys in the order of their UTF-16 units, no blanks, numbers in their one form."""
    pieces = F.split(F.to_json(value), r'"\\u0001(?=-?[0-9])')
    numbers = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda p: F.concat(number(F.substring_index(p, '"', 1)), F.substring(p, F.instr(p, '"') + 1, F.length(p))))
    return F.replace(F.array_join(F.concat(F.slice(pieces, 1, 1), numbers), ""), F.lit("\\u0001\\u0001"), F.lit("\\u0001"))


def _kind(value: Column) -> Column:
    """JSON type of a marked variant: string, integer, number, boolean, array, object or null."""

    def named(v: Column) -> Column:
        shape, text = v["shape"], v["text"]
        whole = number(F.substring(text, F.lit(2), F.length(text))).rlike(r"^-?[0-9]+$|^-?[0-9]+(\.[0-9]+)?e[0-9]+$")
        return (
            F.when((shape == "STRING") & text.rlike(_MARKED), F.when(whole, "integer").otherwise("number"))
            .when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null")
            .when(shape.startswith("ARRAY"), "array").when(shape.startswith("OBJECT"), "object")
        )

    return bound(F.struct(F.schema_of_variant(value).alias("shape"), F.try_variant_get(value, "$", "string").alias("text")), named)


def _fits(kind: Column, name: Column) -> Column:
    """Whether a value of a kind has the type; one that is not known fits anything."""
    return (kind == name) | ((name == "number") & (kind == "integer")) | ~name.isin("string", "integer", "number", "boolean", "array", "object")


def argument_errors(arguments: Column, params: Column) -> Column:
    """Sorted errors of a marked JSON object against params (PARAMS); empty if it is valid.

    key: a name, or names with points between for what lies within objects. type: string,
    integer, number, boolean, array, object, or array<type> for the items too. choices:
    canonical JSON of the values allowed, null for all. Required keys within an object
    that is not there are not missing. Keys of the object that no key begins with are unknown.
    """
    object_of = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    given = object_of(arguments)

    def at(names: Column) -> Column:
        return F.aggregate(names, arguments, lambda v, k: F.try_element_at(object_of(v), k))

    def looked_up(p: Column) -> Column:
        names = F.split(p["key"], r"\.")
        value = at(names)
        return F.struct(p.alias("p"), value.alias("value"), object_of(at(F.slice(names, F.lit(1), F.size(names) - 1))).isNotNull().alias("above"))

    def fault(x: Column) -> Column:
        p, value = x["p"], x["value"]
        item = F.regexp_extract(p["type"], "^array<(.*)>$", 1)
        items = F.try_variant_get(value, "$", "array<variant>")
        fits = F.when(item == "", _fits(_kind(value), p["type"])).otherwise(F.coalesce(F.forall(items, lambda v: _fits(_kind(v), item)), F.lit(False)))
        named = lambda what: F.concat(F.lit(f"{what}:"), p["key"])
        return (
            F.when(value.isNull(), F.when(p["required"] & x["above"], named("missing")))
            .when(~fits, named("type"))
            .when(p["choices"].isNotNull() & ~F.array_contains(p["choices"], canonical(value)), named("choice"))
        )

    unknown = F.transform(F.array_except(F.map_keys(given), F.transform(params, lambda p: F.substring_index(p["key"], ".", 1))), lambda k: F.concat(F.lit("unknown:"), k))
    faults = F.concat(F.filter(F.transform(F.transform(params, looked_up), fault), lambda e: e.isNotNull()), unknown)
    return F.when(params.isNull(), F.array(F.lit("tool"))).when(given.isNull(), F.array(F.lit("json"))).otherwise(F.array_sort(faults))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the number of calls before each one in its chain of parents.

    calls: conv_id, call_id, parent_id, one row for each call. A parent that is null or
    not in the table makes a root, level 0. Calls on or behind a cycle have level null.
    """
    parents = calls.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"))
    known = (calls["conv_id"] == parents["p_conv"]) & (calls["parent_id"] == parents["p_call"])
    now = durable(calls.join(parents.hint("shuffle_hash"), known, "left").select("conv_id", "call_id", F.col("p_call").alias("above"), F.when(F.col("p_call").isNull(), 0).otherwise(1).cast("long").alias("level")))
    steps = max(1, now.count()).bit_length() + 1
    for _ in range(steps):
        if now.filter("above is not null").isEmpty():
            break
        up = now.select(F.col("conv_id").alias("p_conv"), F.col("call_id").alias("p_call"), F.col("above").alias("p_above"), F.col("level").alias("p_level"))
        climbing = now.filter("above is not null")
        climbed = climbing.join(up.hint("shuffle_hash"), (climbing["conv_id"] == up["p_conv"]) & (climbing["above"] == up["p_call"])).select("conv_id", "call_id", F.col("p_above").alias("above"), (F.col("level") + F.col("p_level")).alias("level"))
        now = durable(now.filter("above is null").union(climbed))
    return now.select("conv_id", "call_id", F.when(F.col("above").isNull(), F.col("level")).alias("level"))


def positions(order: DataFrame) -> DataFrame:
    """order (conv_id, call_id, level) with position: numbers from 0 within a conversation, by level, nulls last, and call_id.

    Rows are sorted by ranges and numbered over partitions, so a conversation may fill many of them.
    """
    keys = ["conv_id", F.col("level").isNull(), "level", "call_id"]
    placed = durable(order.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row_id", F.monotonically_increasing_id()))
    part = F.shiftright("row_id", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    numbered = placed.join(F.broadcast(starts), part == F.col("part")).withColumn("row_no", F.col("start") + F.col("row_id").bitwiseAND(F.lit((1 << 33) - 1)))
    first = numbered.groupBy("conv_id").agg(F.min("row_no").alias("first_no"), F.count(F.lit(1)).alias("calls"))
    return joined_back(numbered, first, ["conv_id"], "calls", placed.count()).select("conv_id", "call_id", "level", (F.col("row_no") - F.col("first_no")).alias("position"))


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    """conv_id, call_id, status, level, position, name, valid, errors, n_repeats, message: one row for each call and for each result without one.

    calls: conv_id, call_id, parent_id, name, arguments (JSON text). results: conv_id,
    call_id, content. tools: name, params (PARAMS, choices may be left out).
    status is `linked`, `pending` (no result) or `orphan` (no call; level, position, valid,
    errors and n_repeats are null). position is a topological order within a conversation,
    see positions; what is on a cycle comes last, with level null. Rows with a null id are
    left out; of rows that repeat an id, the smallest stays, nulls first, and n_repeats
    counts the calls that went. Null arguments are no JSON, and neither is an object that
    repeats a key, at any depth; arguments that are none are written as a string, with error
    `json`; other columns are ignored.
    """
    calls = calls.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("name", "arguments", "parent_id")).alias("c"), (F.count(F.lit(1)) - 1).alias("n_repeats"))
    calls = durable(calls.select("conv_id", "call_id", "c.*", "n_repeats"))
    results = results.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("content")).alias("r")).withColumn("answered", F.lit(True))
    if "choices" not in tools.schema["params"].dataType.elementType.names:
        tools = tools.withColumn("params", F.transform("params", lambda p: F.struct(p["key"].alias("key"), p["type"].alias("type"), p["required"].alias("required"), F.lit(None).cast("array<string>").alias("choices"))))
    tools = tools.groupBy("name").agg(F.first("params").alias("params"))
    small = tools.limit(BROADCAST_TOOLS + 1).count() <= BROADCAST_TOOLS
    order = positions(levels(calls.select("conv_id", "call_id", "parent_id")))
    called = calls.drop("parent_id").join(F.broadcast(tools) if small else tools.hint("shuffle_hash"), "name", "left").withColumn("called", F.lit(True))
    both = called.join(order.hint("shuffle_hash"), ["conv_id", "call_id"]).join(results.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    both = both.withColumn("parsed", marked(F.col("arguments")))
    both = both.withColumn("errors", F.when(F.col("called"), argument_errors(F.col("parsed"), F.col("params"))))
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "pending").otherwise("linked")
    given = F.coalesce(canonical(F.col("parsed")), json_string(F.col("arguments")))
    message = F.concat(F.lit('{"arguments":'), given, F.lit(',"id":'), json_string(F.col("call_id")), F.lit(',"name":'), json_string(F.col("name")), F.lit(',"result":'), json_string(F.col("r.content")), F.lit("}"))
    return both.select("conv_id", "call_id", status.alias("status"), "level", "position", "name", (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"), "n_repeats", message.alias("message"))


# Calls read out of plain conversations: each assistant turn is a call, the user turn after it its result.


def tools_of(conversations: DataFrame) -> DataFrame:
    """The tools that calls_of names."""
    params = "array<struct<key:string,type:string,required:boolean>>"
    rows = [
        ("search", [("query", "string", True), ("limit", "integer", False)]),
        ("summarise", [("text", "string", True), ("words", "integer", True)]),
        ("translate", [("text", "string", True), ("to", "string", True)]),
    ]
    return conversations.sparkSession.createDataFrame(rows, f"name string, params {params}")


def _call_id(turn: Column) -> Column:
    return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))


def calls_of(conversations: DataFrame) -> DataFrame:
    """Calls whose number within their conversation halves at each parent: call j follows call (j - 1) div 2."""
    turn, text = F.col("turn").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    odd = F.pmod(turn, F.lit(2))
    number = F.floor((turn + odd) / 2) - 1
    parent = F.when(number > 0, 2 * F.floor((number - 1) / 2) + 2 - odd)
    size = F.length(text)
    words = F.when(size % 7 == 0, F.concat(F.lit('"'), size.cast("string"), F.lit('"'))).otherwise(size.cast("string"))
    search = F.concat(F.lit('{ "query": '), json_string(text), F.lit(', "limit": '), (size % 10).cast("string"), F.lit("}"))
    summarise = F.concat(F.lit('{"words": '), words, F.lit(', "text": '), json_string(text), F.lit("}"))
    translate = F.concat(F.lit('{"text": '), json_string(text), F.when(size % 5 == 0, F.lit(', "into": "en"}')).otherwise(F.lit(', "to": "en"}')))
    kind = turn % 3
    return conversations.filter("role = 'assistant'").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        _call_id(turn).alias("call_id"),
        _call_id(parent).alias("parent_id"),
        F.when(kind == 0, "search").when(kind == 1, "summarise").otherwise("translate").alias("name"),
        F.when(kind == 0, search).when(kind == 1, summarise).otherwise(translate).alias("arguments"),
    )


def results_of(conversations: DataFrame) -> DataFrame:
    """The user turns after the first, as results of the turn before."""
    return conversations.filter("role = 'user' and turn > 0").select(F.col("conv_id").cast("long").alias("conv_id"), _call_id(F.col("turn").cast("long") - 1).alias("call_id"), F.col("text").cast("string").alias("content"))
