"""One query for each extractor, transform, predicate, parser and time form: event_id and value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import expressions, timestamps
from millrace.functions.expressions import Scope
from millrace.operators import parsers
from millrace.queries.tables import LINES, event_lines, table
from millrace.sources import logs

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}

LEVEL = {"type": "leftRight", "leftRight": {"leftIndex": 1, "left": " ", "right": " "}}
COST = {"type": "leftRight", "leftRight": {"left": "cost=", "right": " "}}
USER = {"type": "leftRight", "leftRight": {"left": "user-", "right": "]"}}
REGEXP = r"^(?P<day>\S+) (?P<time>\S+) (?P<level>[A-Z]+) \[(?P<user_name>[^\]]+)\] cost=(?P<cost>[\d.]+)"
SEPARATOR = {"type": "separator", "separator": {"separator": " "}}
BY_NAME = {"type": "regexp", "regexp": {"expression": REGEXP}}
#: Parts of a line in SQL.
SQL_USER = "CAST(user_id AS VARCHAR)"


def _scalar(name: str, value: Callable[[DataFrame], Column], sql: str, parse: dict | None = None, where: str = "", filters: Callable | None = None) -> None:
    def query(spark, sf_dir):
        df = parsers.parse(event_lines(spark, sf_dir), parse)
        df = df.filter(filters(df)) if filters else df
        return df.select(F.col("ord").alias("event_id"), value(df).alias("value"))

    QUERIES[name] = query
    ORACLE_SQL[name] = f"WITH {LINES} SELECT event_id, {sql} AS value FROM lines {where}"


def _elect(name: str, conf: dict, sql: str, parse: dict | None = None, number: bool = False, **scope) -> None:
    make = expressions.numeric if number else expressions.text
    _scalar(name, lambda df: make(conf, Scope(**{k: v() for k, v in scope.items()})), sql, parse)


_elect("E1_line", {"type": "line", "line": {"index": 0}}, "line")
_elect("E2_left_right", LEVEL, "upper(event_type)")
_elect("E2_left_right_number", COST, "CAST(cost AS DOUBLE)", number=True)
_elect("E2_left_right_missing", {"type": "leftRight", "leftRight": {"left": "##", "right": " "}}, "'-'")
_elect("E3_regexp_group", {"type": "regexp", "regexp": {"expression": r"user-(\d+)", "index": 1}}, SQL_USER)
_elect("E3_regexp_name", {"type": "regexp", "regexp": {"expression": r"cost=(?P<the_cost>\d+)\.", "name": "the_cost"}}, "regexp_extract(line, 'cost=(\\d+)\\.', 1)")
_elect("E4_ref_index", {"type": "refIndex", "refIndex": {"index": 2}}, "upper(event_type)", SEPARATOR)
_elect("E5_ref_name", {"type": "refName", "refName": {"name": "user_name"}}, "'user-' || user_id", BY_NAME)
_elect("E5_ref_name_number", {"type": "refName", "refName": {"name": "level"}}, "CAST(0 AS DOUBLE)", BY_NAME, number=True)
_elect("E6_json_path", {"type": "refName", "refName": {"name": "$.k"}}, "CAST(props ->> '$.k' AS VARCHAR)", None, column_json=lambda: F.try_parse_json(F.substring_index("line", "props=", -1)))
_elect("E7_path_var", {"type": "pathVar", "pathVar": {"name": "app"}}, "'shop'", None, path_tags=lambda: F.create_map(F.lit("app"), F.lit("shop")))
_elect("E8_ref_var", {"type": "refVar", "refVar": {"name": "who"}}, "'user-' || user_id", None, variables=lambda: {"who": F.regexp_extract("line", r"\[([^\]]+)\]", 1)})
_elect("E9_ref_meta", {"type": "refMeta", "refMeta": {"name": "hostname"}}, "'host-' || (event_id % 3)", None, meta=lambda: {"hostname": F.concat(F.lit("host-"), (F.col("ord") % 3).cast("string"))})
_elect("E10_context", {"type": "context"}, "lower(event_type)", None, context=lambda: F.lower(expressions.text(LEVEL, Scope())))
_elect("E11_elect_transform", LEVEL | {"transform": {"filters": [{"appendV1": {"value": "!"}}]}}, "upper(event_type) || '!'")


def _transform(name: str, filters: list[dict], sql: str, source: dict = LEVEL) -> None:
    _elect(name, source | {"transform": {"filters": filters}}, sql)


_is = lambda v: {"in": {"values": [v]}}
_transform("F1_append", [{"appendV1": {"value": "R", "appendIfMissing": True}}], "CASE WHEN upper(event_type) LIKE '%R' THEN upper(event_type) ELSE upper(event_type) || 'R' END")
_transform("F2_substring", [{"substringV1": {"begin": 1, "end": 5, "emptyIfError": True}}], "substr(upper(event_type), 2, 4)")
_transform("F3_switch_case", [{"switchCaseV1": {"cases": [{"caseWhere": _is("ERROR"), "action": {"constV1": {"value": "bad"}}}, {"caseWhere": {"contains": {"value": "I"}}, "action": {"appendV1": {"value": "_i"}}}], "defaultAction": {"constV1": {"value": "rest"}}}}], "CASE WHEN event_type = 'error' THEN 'bad' WHEN upper(event_type) LIKE '%I%' THEN upper(event_type) || '_i' ELSE 'rest' END")
_transform("F4_mapping", [{"mappingV1": {"mappings": {"ERROR": "E", "VIEW": "V"}, "defaultValue": "other"}}], "CASE event_type WHEN 'error' THEN 'E' WHEN 'view' THEN 'V' ELSE 'other' END")
_transform("F5_const", [{"constV1": {"value": "all"}}], "'all'")
_transform("F6_regexp_replace", [{"regexpReplaceV1": {"expression": "^(.)(.*)$", "replacement": "${2}-$1-$9"}}], "substr(upper(event_type), 2) || '-' || substr(upper(event_type), 1, 1) || '-$9'")
_transform("F7_template_of_groups", [{"switchCaseV1": {"cases": [{"caseWhere": {"regexp": {"expression": "^(E|S)(.*)$", "catchGroups": True}}, "action": {"regexpReplaceV1": {"replacement": "$1:$2"}}}]}}], "CASE WHEN regexp_matches(upper(event_type), '^(E|S)') THEN substr(upper(event_type), 1, 1) || ':' || substr(upper(event_type), 2) ELSE upper(event_type) END")
_transform("F8_composite", [{"compositeV1": {"filters": [{"appendV1": {"value": "1"}}, {"appendV1": {"value": "2"}}]}}], "upper(event_type) || '12'")
_transform("F9_discard", [{"discardV1": {}}], "''")


def _clean_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", expressions.clean_url(F.col("url")).alias("value"))


QUERIES["F10_clean_url"] = _clean_url
ORACLE_SQL["F10_clean_url"] = "SELECT page_id, url_decode(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS value FROM pages"


def _where(name: str, where: dict, sql: str, parse: dict | None = None) -> None:
    def query(spark, sf_dir):
        df = parsers.parse(event_lines(spark, sf_dir), parse)
        condition, scope = expressions.predicate(where, Scope())
        return df.filter(F.coalesce(condition, F.lit(False))).select(F.col("ord").alias("event_id"), F.size(scope.columns).alias("value"))

    QUERIES[name] = query
    groups = 3 if "catchGroups" in str(where) else 0
    ORACLE_SQL[name] = f"WITH {LINES} SELECT event_id, {groups} AS value FROM lines WHERE {sql}"


_has = lambda v, **k: {"contains": {"elect": {"type": "line"}, "value": v, **k}}
_over = {"numberOp": {"elect": COST, "gt": 50}}
_bad = {"numberOp": {"elect": LEVEL, "gt": 0}}
_where("W1_and", {"and": [_has("ERROR"), _over]}, "event_type = 'error' AND cost > 50")
_where("W2_or", {"or": [_has("ERROR"), _over]}, "event_type = 'error' OR cost > 50")
_where("W2_or_error", {"or": [_bad, _has("ERROR")]}, "false")
_where("W3_not", {"not": _has("ERROR")}, "event_type <> 'error'")
_where("W3_not_error", {"not": _bad}, "false")
_where("W4_contains", _has("view", ignoreCase=True), "event_type = 'view'")
_where("W5_contains_any", {"containsAny": {"elect": {"type": "line"}, "values": ["VIEW", "CLICK"]}}, "event_type IN ('view', 'click')")
_where("W6_contains_multiline", _has("SIGNUP", multiline=True), "event_type = 'signup'")
_where("W7_in", {"in": {"elect": LEVEL, "values": ["error", "view"], "ignoreCase": True}}, "event_type IN ('error', 'view')")
_where("W8_number_op", {"numberOp": {"elect": COST, "gte": 10, "lt": 20}}, "cost >= 10 AND cost < 20")
_where("W9_number_between", {"numberBetween": {"elect": COST, "min": 10, "max": 20, "minIncluded": True}}, "cost >= 10 AND cost < 20")
_where("W10_regexp", {"regexp": {"elect": {"type": "line"}, "expression": r"user-1\d\]"}}, "regexp_matches(line, 'user-1\\d\\]')")
_where("W11_regexp_multiline", {"regexp": {"multiline": True, "expression": r"cost=9\."}}, "regexp_matches(line, 'cost=9\\.')")
_where("W12_catch_groups", {"regexp": {"elect": {"type": "line"}, "expression": r"user-(\d)(\d)\]", "catchGroups": True}}, "regexp_matches(line, 'user-(\\d)(\\d)\\]')")


def _parsed(name: str, parse: dict, value: Callable[[], Column], sql: str) -> None:
    _scalar(name, lambda df: value(), sql, parse)


_parsed("P1_none", {}, lambda: F.size("columns"), "0")
_parsed("P2_separator", SEPARATOR, lambda: F.concat_ws("|", "columns"), "array_to_string(string_split(line, ' '), '|')")
_parsed("P4_regexp", BY_NAME, lambda: F.concat(F.col("columns")[2], F.lit("/"), F.col("column_map")["cost"]), "upper(event_type) || '/' || cost")
GROK = r"%{TIMESTAMP_ISO8601:at} %{LOGLEVEL:level} \[user-%{INT:user:int}\] cost=%{NUMBER:cost:float}"
_parsed("P5_grok", {"type": "grok", "grok": {"expression": r"%{DATE:day} %{TIME} %{WORD:level} \[user-%{INT:user:int}\]"}}, lambda: F.concat_ws("/", "columns"), f"strftime(ts, '%Y-%m-%d') || '/' || upper(event_type) || '/' || {SQL_USER}")
_scalar("P5_grok_typed", lambda df: parsers.grok_typed(F.col("line"), r"user-%{INT:user:int}\] cost=%{NUMBER:cost:float}")["user"], "user_id")
_scalar("P6_split_to_map", lambda df: F.to_json(logs.split_to_map(F.col("line"), r"user-(?P<user>\d+)\] cost=(?P<cost>[\d.]+)")), "'{\"user\":\"' || user_id || '\",\"cost\":\"' || cost || '\"}'")


def _json(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("line", F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("{"))).otherwise(F.col("props")))
    df = parsers.parse(e, {"type": "json"})
    return df.select("event_id", F.try_variant_get("column_json", "$.k", "long").alias("value"))


QUERIES["P3_json"] = _json
ORACLE_SQL["P3_json"] = "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS value FROM events WHERE event_id % 5 <> 0"


def _pre_where(spark, sf_dir):
    return parsers.before_parsing(event_lines(spark, sf_dir), _has("ERROR")).select(F.col("ord").alias("event_id"), F.col("line").alias("value"))


QUERIES["P7_pre_where"] = _pre_where
ORACLE_SQL["P7_pre_where"] = f"WITH {LINES} SELECT event_id, line AS value FROM lines WHERE event_type = 'error'"


def _time(name: str, line: Callable[[], Column], conf: dict, sql: str = "epoch_ms(date_trunc('second', ts))") -> None:
    def query(spark, sf_dir):
        e = table(spark, sf_dir, "events")
        df = e.withColumn("line", line())
        moment = timestamps.event_time(conf, Scope())
        df = df.withColumn("moment", moment).filter(timestamps.usable(F.col("moment")))
        return df.select("event_id", F.unix_millis("moment").alias("value"))

    QUERIES[name] = query
    ORACLE_SQL[name] = f"SELECT event_id, {sql} AS value FROM events"


_fmt = lambda pattern, left="": (lambda: F.concat(F.lit(left), F.date_format("ts", pattern), F.lit(" tail")))
_seconds = lambda: F.unix_seconds(F.col("ts").cast("timestamp"))
_first = {"type": "leftRight", "leftRight": {"left": "", "right": " "}}
_time("D1_auto", _fmt("yyyy-MM-dd HH:mm:ss.SSS", "["), {"type": "auto"}, "epoch_ms(date_trunc('millisecond', ts))")
_time("D1_auto_slashes", _fmt("yyyy/MM/dd HH:mm:ss"), {"type": "auto"})
_time("D1_auto_month", _fmt("dd/MMM/yyyy HH:mm:ss", "[["), {"type": "auto"})
_time("D1_auto_digits", lambda: F.concat(_seconds().cast("string"), F.lit(" x")), {"type": "auto"})
_time("D3_unix", lambda: F.concat(_seconds().cast("string"), F.lit(" x")), {"type": "elect", "elect": _first, "format": "unix"})
_time("D4_unix_milli", lambda: F.concat((_seconds() * 1000).cast("string"), F.lit(" x")), {"type": "elect", "elect": _first, "format": "unixMilli"})
_time("D5_layout", _fmt("yyyyMMdd-HHmmss"), {"type": "elect", "elect": _first, "format": "golangLayout", "layout": "20060102-150405", "timezone": "Asia/Shanghai"}, "epoch_ms(date_trunc('second', ts)) - 28800000")
_time("D6_elect_auto", _fmt("yyyy-MM-dd'T'HH:mm:ss"), {"type": "elect", "elect": _first, "format": "auto"})
_time("D7_zones", _fmt("yyyy-MM-dd'T'HH:mm:ss,SSS'+08:00'"), {"type": "auto"}, "epoch_ms(date_trunc('millisecond', ts)) - 28800000")


def _bad_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("line", F.when(F.col("event_id") % 4 == 0, "no time here").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return e.filter(timestamps.usable(timestamps.auto(F.col("line")))).select("event_id", F.lit(1).alias("value"))


QUERIES["D8_bad_time"] = _bad_times
ORACLE_SQL["D8_bad_time"] = "SELECT event_id, 1 AS value FROM events WHERE event_id % 4 <> 0"


def _process_time(spark, sf_dir):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return event_lines(spark, sf_dir).select(F.col("ord").alias("event_id"), F.unix_millis(timestamps.event_time({"type": "processTime"}, Scope(), now=now)).alias("value"))


QUERIES["D2_process_time"] = _process_time
ORACLE_SQL["D2_process_time"] = "SELECT event_id, epoch_ms(TIMESTAMP '2024-02-01') AS value FROM events"
