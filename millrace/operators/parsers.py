"""Records into columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dialect import plain_groups, quoted
from millrace.functions.expressions import Scope, keeps

#: Patterns that %{NAME} refers to; own definitions of the customary names.
GROK = {
    "INT": r"[+-]?\d+", "NUMBER": r"[+-]?(?:\d+\.?\d*|\.\d+)", "WORD": r"\w+", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*",
    "IPV4": r"(?:\d{1,3}\.){3}\d{1,3}", "IP": r"%{IPV4}", "HOSTNAME": r"[\w.-]+", "USER": r"[\w.@-]+", "LOGLEVEL": r"(?:TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERROR|FATAL)",
    "DATE": r"\d{4}-\d{2}-\d{2}", "TIME": r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", "TIMESTAMP_ISO8601": r"%{DATE}[T ]%{TIME}(?:Z|[+-]\d{2}:?\d{2})?", "QUOTEDSTRING": r'"[^"]*"', "UUID": r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", "PATH": r"/\S*",
}
_GROK = re.compile(r"%\{(\w+)(?::([\w.-]+))?(?::(int|float|string))?\}")


def grok_regexp(expression: str, patterns: dict[str, str] | None = None) -> tuple[str, list[tuple[str, str]]]:
    """A grok expression as a pattern with one group for each named capture, and (name, type) of each."""
    known, captures = GROK | (patterns or {}), []

    def expand(text: str, capture: bool) -> str:
        def one(m: re.Match) -> str:
            inner = expand(known[m[1]], False)
            if capture and m[2]:
                captures.append((m[2], m[3] or "string"))
                return f"({inner})"
            return f"(?:{inner})"

        return _GROK.sub(one, text)

    return expand(expression, True), captures


def _empty() -> dict[str, Column]:
    return {"columns": F.array().cast("array<string>"), "column_map": F.create_map().cast("map<string,string>")}


def _groups(df: DataFrame, pattern: str, names: list[str]) -> tuple[DataFrame, Column]:
    """Columns by position and by name from the groups of the first match, and whether there is one."""
    found = [F.regexp_extract("line", pattern, i) for i in range(1, len(names) + 1)]
    pairs = [c for n, g in zip(names, found, strict=True) if n for c in (F.lit(n), g)]
    new = _empty()
    if found:
        new["columns"] = F.array(*found)
    if pairs:
        new["column_map"] = F.create_map(*pairs)
    return df.withColumns(new), F.col("line").rlike(pattern)


def parse(df: DataFrame, conf: dict | None) -> DataFrame:
    """df with columns, column_map and, for JSON, column_json (VARIANT); rows that do not parse are dropped."""
    parsed, fits = parsed_and_fits(df, conf)
    return parsed if fits is None else parsed.filter(fits)


def parsed_and_fits(df: DataFrame, conf: dict | None) -> tuple[DataFrame, Column | None]:
    """All rows of df as parse would leave them, and whether a row parses; None where all do."""
    conf = conf or {}
    kind = conf.get("type") or "none"
    df = df.withColumns({k: v for k, v in _empty().items() if k not in df.columns})
    if kind == "separator":
        separator = conf["separator"]["separator"]
        if not separator:
            raise ValueError("the separator is empty")
        return df.withColumn("columns", F.split("line", quoted(separator), -1)), None
    if kind == "json":
        # The parser alone would take text after the object.
        value = F.when(F.col("line").rlike(r"\}\s*$"), F.try_parse_json("line"))
        applies = (F.size("column_map") == 0) & F.col("line").startswith("{")
        return df.withColumn("column_json", F.when(applies, value)), ~applies | F.col("column_json").isNotNull()
    if kind == "regexp":
        return _groups(df, *plain_groups(conf["regexp"]["expression"]))
    if kind == "grok":
        pattern, captures = grok_regexp(conf["grok"]["expression"])
        return _groups(df, pattern, [n for n, _ in captures])
    return df, None


def grok_typed(line: Column, expression: str) -> dict[str, Column]:
    """The typed captures of a grok expression; NULL without a match."""
    pattern, captures = grok_regexp(expression)
    types = {"int": "bigint", "float": "double", "string": "string"}
    return {n: F.when(line.rlike(pattern), F.regexp_extract(line, pattern, i).try_cast(types[t])) for i, (n, t) in enumerate(captures, 1)}


def before_parsing(df: DataFrame, where: dict | None) -> DataFrame:
    """Records whose lines, joined, pass a condition."""
    return df.filter(keeps(where, Scope(line=F.array_join("lines", "\n")))) if where else df
