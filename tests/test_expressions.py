"""Values of extractors, transforms, predicates and times."""

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import dialect, expressions, timestamps
from millrace.functions.expressions import Scope
from millrace.operators import aggregate, parsers
from millrace.sources import logs, paths

CONTEXT = {"type": "context"}


def transformed(spark, value, *filters):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expressions.transform(F.col("x"), list(filters), Scope())).first()[0]


def case(value, action):
    return {"caseWhere": {"in": {"elect": CONTEXT, "values": [value]}}, "action": action}


@pytest.mark.parametrize(("value", "expected"), [("aaa", "aaa_aaa_aaa"), ("bbb", "bbb_bbb"), ("ccc", "ccc_ccc")])
def test_switch_and_composite(spark, value, expected):
    append = lambda v: {"appendV1": {"value": v}}
    cases = [case("aaa", {"compositeV1": {"filters": [append("_aaa"), append("_aaa")]}}), case("bbb", append("_bbb"))]
    assert transformed(spark, value, {"switchCaseV1": {"cases": cases, "defaultAction": append("_ccc")}}) == expected


@pytest.mark.parametrize(("value", "expected"), [("a", "aa"), ("b", "bb"), ("c", "xx")])
def test_mapping(spark, value, expected):
    assert transformed(spark, value, {"mappingV1": {"mappings": {"a": "aa", "b": "bb"}, "defaultValue": "xx"}}) == expected


@pytest.mark.parametrize(("begin", "end", "empty", "expected"), [(5, -1, False, "mill"), (5, 7, False, "mi"), (100, -1, True, ""), (100, -1, False, None), (-3, 4, False, "wate"), (2, 1, True, "")])
def test_substring(spark, begin, end, empty, expected):
    assert transformed(spark, "watermill"[:9], {"substringV1": {"begin": begin, "end": end, "emptyIfError": empty}}) == expected


def test_substring_counts_bytes(spark):
    assert transformed(spark, "äbc", {"substringV1": {"begin": 2, "end": 3}}) == "b"


def test_an_error_ends_the_chain(spark):
    assert transformed(spark, "ab", {"substringV1": {"begin": 9, "end": -1}}, {"constV1": {"value": "x"}}) is None


def test_regexp_replace_and_template(spark):
    replace = {"regexpReplaceV1": {"expression": "water(.*)", "replacement": "Water${1}XXX"}}
    assert transformed(spark, "a watermill", replace) == "WatermillXXX"
    assert transformed(spark, "windmill", replace) == "windmill"
    caught = {"caseWhere": {"regexp": {"elect": CONTEXT, "expression": "water(.*)", "catchGroups": True}}, "action": {"regexpReplaceV1": {"replacement": "Water${1}XXX"}}}
    assert transformed(spark, "watermill", {"switchCaseV1": {"cases": [caught]}}) == "WatermillXXX"
    df = spark.createDataFrame([(["_", "aaa", "bbb", "ccc"],)], "g array<string>")
    assert df.select(expressions.render("a-$1x-x${2}x,x${3}x,$4abc", F.col("g"), ["", "", ""], 3)).first()[0] == "a-aaax-xbbbx,xcccx,$4abc"


@pytest.mark.parametrize(("url", "path"), [("https://example.org/a/b?c=d", "/a/b"), ("/a/b?c=d", "/a/b"), ("http://h/x%20y+z", "/x y+z"), ("http://h/%zz", "http://h/%zz"), ("plain", "plain")])
def test_clean_url(spark, url, path):
    assert transformed(spark, url, {"cleanUrlV1": {}}) == path


def line_value(spark, line, conf, number=False):
    df = spark.createDataFrame([(line,)], "line string")
    return df.select((expressions.numeric if number else expressions.text)(conf, Scope(lines=F.array("line")))).first()[0]


@pytest.mark.parametrize(("line", "index", "left", "right", "expected"), [("a[b]c[d]e", 1, "[", "]", "d"), ("a[b]", 1, "[", "]", "-"), ("a[]", 0, "[", "]", "-"), ("k=v", 0, "k=", "", "v"), ("k=v", 0, "", "=", "k"), ("x=$1.5|", 0, "$", "|", "1.5")])
def test_left_right(spark, line, index, left, right, expected):
    assert line_value(spark, line, {"type": "leftRight", "leftRight": {"leftIndex": index, "left": left, "right": right}}) == expected


@pytest.mark.parametrize(("text", "expected"), [("1.5", 1.5), ("-2e3", -2000.0), ("1d", None), (" 1", None), ("", None), (".5", 0.5), ("Infinity", float("inf"))])
def test_numbers(spark, text, expected):
    assert spark.createDataFrame([(text,)], "x string").select(dialect.number(F.col("x"))).first()[0] == expected


def test_pattern_groups():
    assert dialect.plain_groups(r"(?P<a_b>\d+)-(?:x)(y)[(]\(") == (r"(\d+)-(?:x)(y)[(]\(", ["a_b", ""])


@pytest.mark.parametrize("combine", ["and", "or"])
def test_an_error_is_not_null(spark, combine):
    bad = {"numberOp": {"elect": {"type": "line"}, "gt": 0}}
    yes, no = {"contains": {"value": "a"}}, {"contains": {"value": "z"}}
    df = spark.createDataFrame([("a", ["a"])], "line string, lines array<string>")
    keeps = lambda w: df.filter(expressions.keeps(w, Scope())).count() == 1
    assert not keeps({combine: [bad, yes]})
    assert keeps({"or": [yes, bad]})
    assert not keeps({"not": {"and": [bad, no]}})
    assert keeps({}) and keeps(None)
    assert keeps({"not": {"and": [no, bad]}})


SECOND = datetime(2021, 1, 2, 3, 4, 5, tzinfo=UTC)


@pytest.mark.parametrize(
    ("line", "millis"),
    [
        ("2021-01-02 03:04:05 INFO x", 0), ("2021-01-02 03:04:05,123 INFO", 123), ("[2021/01/02 03:04:05] x", 0), ("[[02/Jan/2021 03:04:05]] x", 0), ("[[2021 Jan/02 03:04:05]]", 0),
        ("[[Jan 02 2021 03:04:05]]", 0), ("01/02/2021 03:04:05 x", 0), ("2021-01-02T03:04:05.250Z x", 250), ("2021-01-02T11:04:05+08:00 x", 0), ("02/Jan/2021:11:04:05 +0800] x", 0),
        ("Sat Jan  2 03:04:05 2021 x", 0), ("Sat Jan  2 03:04:05 UTC 2021", 0), ("1609556645 x", 0), ("1609556645123 x", 123), ("12345 2021-01-02 03:04:05", None), ("nothing", None), ("1609556645", None),
    ],
)
def test_auto_time(spark, line, millis):
    found = spark.createDataFrame([(line,)], "line string").select(F.unix_millis(timestamps.auto(F.col("line")))).first()[0]
    assert found == (None if millis is None else int(SECOND.timestamp() * 1000) + millis)


def test_time_zone_and_layouts(spark):
    df = spark.createDataFrame([("2021-01-02 03:04:05",)], "line string")
    assert df.select(F.unix_millis(timestamps.auto(F.col("line"), "Asia/Shanghai"))).first()[0] == 1609527845000
    assert timestamps.java_pattern("02/Jan/2006:15:04:05 Z0700") == "dd/MMM/yyyy:HH:mm:ss XX"


@pytest.mark.parametrize(("text", "millis"), [("100ms", 100), ("100", 100), (100, 100), ("100.0", 100), ("1m30s", 90_000)])
def test_durations(text, millis):
    assert aggregate.interval_ms(text) == millis


def test_bad_duration():
    with pytest.raises(ValueError):
        aggregate.interval_ms("-100.0")


def test_paths():
    at = datetime(2024, 3, 5, 7)
    assert paths.dated("/a/{time:yyyy-MM-dd}/{time:H}.log", at) == "/a/2024-03-05/7.log"
    assert len(paths.dated_range("/a/{time:yyyyMMddHH}.log", at, datetime(2024, 3, 5, 9))) == 3
    with pytest.raises(ValueError):
        paths.checked_glob("/")


def test_files(spark, tmp_path):
    for kind in ("app", "web"):
        (tmp_path / kind).mkdir()
        (tmp_path / kind / "x.log").write_text("one\r\ntwo\n")
        (tmp_path / kind / ".hidden.log").write_text("no\n")
    found = logs.read_template(spark, str(tmp_path), "/{type}/{name}.log")
    got = sorted((r["path_tags"]["type"], r["path_tags"]["name"], r["line"]) for r in found.collect())
    assert got == [(k, "x", line) for k in ("app", "web") for line in ("one", "two")]
    assert logs.tail(logs.read_log_lines(spark, [f"{tmp_path}/*/x.log"]), 1).count() == 2


def test_charset(spark, tmp_path):
    (tmp_path / "g.log").write_bytes("中文 ok\n".encode("gb18030") + "中文 utf\n".encode())
    assert sorted(r["line"] for r in logs.read_log_lines(spark, [str(tmp_path / "g.log")], "GBK").collect()) == ["中文 ok", "中文 utf"]


def test_noise_and_broken(spark):
    df = spark.createDataFrame([("",), ("\tat x",), ("\t... 3 more",), ("ok",), ("\0" * 5000,)], "line string")
    assert [r["line"] for r in df.filter(~logs.noise(F.col("line")) & ~logs.broken(F.col("line"))).collect()] == ["ok"]


def test_parsers(spark):
    df = spark.createDataFrame([("abc-123", ["abc-123"]), ("?", ["?"])], "line string, lines array<string>")
    row = parsers.parse(df, {"type": "regexp", "regexp": {"expression": r"(?P<first>[a-z]+)-(?P<second>\d+)"}}).collect()
    assert [(r["columns"], r["column_map"]) for r in row] == [(["abc", "123"], {"first": "abc", "second": "123"})]
    assert parsers.parse(df, {"type": "grok", "grok": {"expression": "%{WORD:w}-%{INT:n:int}"}}).first()["columns"] == ["abc", "123"]
    with pytest.raises(ValueError):
        parsers.parse(df, {"type": "separator", "separator": {"separator": ""}})
    objects = spark.createDataFrame([('{"a": {"b": 1}}',), ("{bad",), ("text",)], "line string")
    parsed = parsers.parse(objects, {"type": "json"})
    assert parsed.count() == 2
    path = expressions.text({"type": "refName", "refName": {"name": "$.a.b"}}, Scope(column_json=F.col("column_json"), log_tags=F.create_map().cast("map<string,string>")))
    assert sorted(r[0] for r in parsed.select(path).collect()) == ["", "1"]
