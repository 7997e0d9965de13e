"""Extractors, transforms and predicates of a task, compiled to Columns.

Configurations are plain dicts in the shape of a task's JSON. A compiled text, number or
predicate is NULL where the row has an error at that step; callers decide whether an
error drops the row or only the value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dialect import captures, number, plain_groups, quoted

_REFERENCE = re.compile(r"\$(?:\{(\w+)\}|(\d+))")


@dataclass(frozen=True)
class Scope:
    """The columns that expressions refer to."""

    line: Column = field(default_factory=lambda: F.col("line"))
    lines: Column = field(default_factory=lambda: F.col("lines"))
    columns: Column = field(default_factory=lambda: F.col("columns"))
    names: tuple[str, ...] = ()
    column_map: Column = field(default_factory=lambda: F.col("column_map"))
    column_json: Column | None = None
    log_tags: Column = field(default_factory=lambda: F.col("log_tags"))
    path_tags: Column = field(default_factory=lambda: F.col("path_tags"))
    variables: dict[str, Column] = field(default_factory=dict)
    meta: dict[str, Column] = field(default_factory=dict)
    context: Column | None = None


# extractors


def text(conf: dict | None, scope: Scope) -> Column:
    """The extracted string."""
    conf = conf or {"type": "line"}
    value = _text(conf, scope)
    filters = (conf.get("transform") or {}).get("filters")
    return transform(value, filters, scope) if filters else value


def _text(conf: dict, scope: Scope) -> Column:
    kind = conf.get("type", "line")
    own = conf.get(kind) or {}
    if kind == "line":
        index = own.get("index", 0)
        return F.coalesce(F.get(scope.lines, F.lit(index)), F.lit("")) if index else scope.line
    if kind == "leftRight":
        return left_right(scope.line, own.get("leftIndex", 0), own.get("left", ""), own.get("right", ""))
    if kind == "regexp":
        return regexp(scope.line, own["expression"], own.get("name") or own.get("index", 0))
    if kind == "refIndex":
        return F.get(scope.columns, F.lit(own["index"]))
    if kind == "refName":
        return F.coalesce(named(own["name"], scope), F.lit(""))
    if kind == "pathVar":
        return F.coalesce(scope.path_tags[own["name"]], F.lit(""))
    if kind == "refVar":
        return scope.variables[own["name"]]
    if kind == "refMeta":
        return scope.meta[own["name"]]
    if kind == "context":
        return scope.context
    raise ValueError(f"unknown extractor {kind!r}")


def numeric(conf: dict | None, scope: Scope) -> Column:
    """The extracted number."""
    conf = conf or {"type": "line"}
    kind = conf.get("type", "line")
    if kind in ("line", "refMeta") and not conf.get("transform"):
        return F.lit(None).cast("double")
    value = number(text(conf, scope))
    # By-name lookups count bad or missing numbers as 0.
    return F.coalesce(value, F.lit(0.0)) if kind in ("refName", "pathVar") and not conf.get("transform") else value


def left_right(line: Column, left_index: int, left: str, right: str) -> Column:
    """What stands between the left text's occurrence left_index (from 0) and the next right text or the end; '-' if nothing does."""
    if left_index < 0:
        raise ValueError("leftIndex must not be negative")
    if not left:
        rest = line
    elif any(left.startswith(left[k:]) for k in range(1, len(left))):
        # Occurrences may overlap, which substring_index would count.
        rest = F.get(F.split(line, quoted(left), left_index + 2), F.lit(left_index + 1))
    else:
        before = F.length(F.substring_index(line, left, left_index + 1))
        rest = F.when(before < F.length(line), F.substring(line, before + (1 + len(left)), F.length(line)))
    found = F.substring_index(rest, right, 1) if right else rest
    return F.when(line.isNotNull(), F.coalesce(F.nullif(found, F.lit("")), F.lit("-")))


def regexp(value: Column, expression: str, group: int | str) -> Column:
    """A group of the first match, by number or name; NULL without a match."""
    pattern, names = plain_groups(expression)
    index = names.index(group) + 1 if isinstance(group, str) else group
    return F.when(value.rlike(pattern), F.regexp_extract(value, pattern, index))


def named(name: str, scope: Scope) -> Column:
    """A parsed column by name or JSON path, or else a log tag; NULL if there is none."""
    if scope.column_json is not None:
        path = name if name.startswith("$") else f"$['{name}']" if re.search(r"\W", name) else f"$.{name}"
        found = F.try_variant_get(scope.column_json, path, "string")
        return found if name.startswith("$") else F.coalesce(found, scope.log_tags[name])
    return F.coalesce(scope.column_map[name], scope.log_tags[name])


# transforms


def transform(value: Column, filters: list[dict], scope: Scope) -> Column:
    """A chain of filters; an error ends it."""
    for conf in filters:
        value = _filter(value, conf, scope)
    return value


def _filter(x: Column, conf: dict, scope: Scope) -> Column:
    kind, own = next(((k, v or {}) for k, v in conf.items() if v is not None), (None, {}))
    maker = _FILTERS.get(kind)
    return F.when(x.isNotNull(), maker(x, own, scope)) if maker else x


def append(x: Column, conf: dict, scope: Scope) -> Column:
    added = F.concat(x, F.lit(conf.get("value", "")))
    return F.when(x.endswith(conf.get("value", "")), x).otherwise(added) if conf.get("appendIfMissing") else added


def substring(x: Column, conf: dict, scope: Scope) -> Column:
    """Bytes begin to end; an empty range is an error or, with emptyIfError, empty."""
    raw = F.encode(x, "UTF-8")
    begin, end = max(0, conf.get("begin", 0)), conf.get("end", -1)
    stop = F.octet_length(x) if end < 0 else F.least(F.lit(end), F.octet_length(x))
    cut = F.make_valid_utf8(F.substring(raw, F.lit(begin + 1), stop - begin).cast("string"))
    return F.when(F.lit(begin) < stop, cut).otherwise(F.lit("" if conf.get("emptyIfError") else None))


def switch_case(x: Column, conf: dict, scope: Scope) -> Column:
    default = conf.get("defaultAction")
    result = _filter(x, default, scope) if default else x
    for case in reversed(conf.get("cases", [])):
        condition, inner = predicate(case.get("caseWhere"), replace(scope, context=x))
        result = F.when(F.coalesce(condition, F.lit(False)), _filter(x, case.get("action") or {}, inner)).otherwise(result)
    return result


def mapping(x: Column, conf: dict, scope: Scope) -> Column:
    pairs = conf.get("mappings") or {}
    default = F.lit(conf["defaultValue"]) if conf.get("defaultValue") else x
    if not pairs:
        return default
    return F.coalesce(F.create_map(*[F.lit(t) for kv in pairs.items() for t in kv])[x], default)


def constant(x: Column, conf: dict, scope: Scope) -> Column:
    return F.lit(conf["value"]) if conf.get("value") else x


def render(template: str, groups: Column, names: list[str], count: int) -> Column:
    """The template with $n and ${n} from groups (0: whole match); a reference to none stays as it is."""
    parts, at = [], 0
    for m in _REFERENCE.finditer(template):
        key = m[1] or m[2]
        index = int(key) if key.isdigit() else names.index(key) + 1 if key in names else -1
        if 0 <= index <= count:
            parts += [F.lit(template[at : m.start()]), F.coalesce(F.get(groups, F.lit(index)), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def regexp_replace(x: Column, conf: dict, scope: Scope) -> Column:
    """The whole value becomes the rendered template where the pattern is found."""
    if not conf.get("expression"):
        return render(conf.get("replacement", ""), scope.columns, list(scope.names), len(scope.names))
    pattern, names = plain_groups(conf["expression"])
    return F.when(x.rlike(pattern), render(conf.get("replacement", ""), captures(x, pattern, len(names)), names, len(names))).otherwise(x)


def clean_url(x: Column, conf: dict | None = None, scope: Scope | None = None) -> Column:
    """The decoded path of an http URL, the URL itself if it is none; anything else up to its first '?'."""
    path = F.try_url_decode(F.replace(F.try_parse_url(x, F.lit("PATH")), F.lit("+"), F.lit("%2B")))
    return F.when(x.startswith("http"), F.coalesce(path, x)).otherwise(F.substring_index(x, "?", 1))


_FILTERS = {
    "appendV1": append,
    "substringV1": substring,
    "switchCaseV1": switch_case,
    "mappingV1": mapping,
    "constV1": constant,
    "regexpReplaceV1": regexp_replace,
    "compositeV1": lambda x, conf, scope: transform(x, conf.get("filters", []), scope),
    "discardV1": lambda x, conf, scope: F.lit(""),
    "cleanUrlV1": clean_url,
}


# predicates


def both(a: Column, b: Column) -> Column:
    """a and b, left to right; an error ends it."""
    return F.when(a.isNull(), None).when(~a, False).otherwise(b)


def either(a: Column, b: Column) -> Column:
    """a or b, left to right; an error ends it."""
    return F.when(a.isNull(), None).when(a, True).otherwise(b)


def predicate(where: dict | None, scope: Scope) -> tuple[Column, Scope]:
    """The condition, NULL on error, and the scope for what follows a match."""
    for kind, own in (where or {}).items():
        if own is None:
            continue
        if kind in ("and", "or"):
            condition = None
            for part in own:
                more, scope = predicate(part, scope)
                condition = more if condition is None else (both if kind == "and" else either)(condition, more)
            return (F.lit(True) if condition is None else condition), scope
        if kind == "not":
            return ~predicate(own, scope)[0], scope
        if kind == "regexp":
            return _regexp(own, scope)
        return _SIMPLE[kind](own, scope), scope
    return F.lit(True), scope


def keeps(where: dict | None, scope: Scope) -> Column:
    """True where the condition holds; false otherwise and on errors."""
    return F.coalesce(predicate(where, scope)[0], F.lit(False))


def _subject(conf: dict, scope: Scope) -> Column:
    return text(conf.get("elect") or ({"type": "context"} if scope.context is not None else None), scope)


def _regexp(conf: dict, scope: Scope) -> tuple[Column, Scope]:
    pattern, names = plain_groups(conf["expression"])
    if conf.get("multiline"):
        return F.exists(scope.lines, lambda line: line.rlike(pattern)), scope
    value = _subject(conf, scope)
    if conf.get("catchGroups"):
        return value.rlike(pattern), replace(scope, columns=captures(value, pattern, len(names)), names=tuple(names))
    return value.rlike(pattern), scope


def _contains_any(conf: dict, scope: Scope) -> Column:
    fold = F.lower if conf.get("ignoreCase") else (lambda c: c)
    words = [w.lower() if conf.get("ignoreCase") else w for w in conf.get("values", [])]

    def test(value: Column) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | F.contains(fold(value), F.lit(w))
        return found

    return F.exists(scope.lines, test) if conf.get("multiline") else test(_subject(conf, scope))


def _contains(conf: dict, scope: Scope) -> Column:
    return _contains_any(conf | {"values": [conf.get("value", "")]}, scope)


def _in(conf: dict, scope: Scope) -> Column:
    value, values = _subject(conf, scope), conf.get("values", [])
    return F.lower(value).isin([v.lower() for v in values]) if conf.get("ignoreCase") else value.isin(values)


def _number_op(conf: dict, scope: Scope) -> Column:
    value = numeric(conf.get("elect") or ({"type": "context"} if scope.context is not None else None), scope)
    tests = {"gt": value.__gt__, "gte": value.__ge__, "lt": value.__lt__, "lte": value.__le__}
    condition = F.when(value.isNotNull(), True)
    for k, name in enumerate(n for n in tests if conf.get(n) is not None):
        one = tests[name](float(conf[name]))
        condition = condition & one if k else one
    return condition


def _number_between(conf: dict, scope: Scope) -> Column:
    value = numeric(conf.get("elect"), scope)
    if conf.get("parseNumberToInt"):
        value = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("double")
    low, high = float(conf.get("min", 0)), float(conf.get("max", 0))
    above = value >= low if conf.get("minIncluded") else value > low
    return above & (value <= high if conf.get("maxIncluded") else value < high)


_SIMPLE = {"contains": _contains, "containsAny": _contains_any, "in": _in, "numberOp": _number_op, "numberBetween": _number_between}
