"""Which files a log task reads."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.dialect import plain_groups

# Fields of a date template and their formats.
_DATE = {"yyyy": "%Y", "MM": "%m", "M": "%-m", "dd": "%d", "d": "%-d", "HH": "%H", "H": "%-H"}
_TIME = re.compile(r"\{time:([^}]*)\}")


def checked_glob(pattern: str) -> str:
    if pattern in ("", "/"):
        raise ValueError("a glob must name more than the root")
    return pattern


def dated(template: str, at: datetime) -> str:
    """A path with {time:yyyy|MM|M|dd|d|HH|H} filled in for a moment."""
    field = re.compile("|".join(sorted(_DATE, key=len, reverse=True)))
    return _TIME.sub(lambda m: field.sub(lambda f: at.strftime(_DATE[f[0]]), m[1]), template)


def dated_range(template: str, start: datetime, end: datetime) -> list[str]:
    """The different paths of all hours from start to end, for a backfill."""
    hours = int((end - start) / timedelta(hours=1)) + 1
    return list(dict.fromkeys(dated(template, start + timedelta(hours=h)) for h in range(max(0, hours))))


def template_regexp(template: str) -> str:
    """A path template with {name} parts as a pattern with named groups."""
    return "^" + "".join(f"(?P<{p[1:-1]}>[^/]+)" if p.startswith("{") else re.escape(p) for p in re.split(r"(\{\w+\})", template)) + "$"


def path_matches(path: Column, pattern: str) -> Column:
    """True for a visible file whose path matches."""
    return path.rlike(plain_groups(pattern)[0]) & ~path.rlike(r"(^|/)\.[^/]*$")


def path_tags(path: Column, pattern: str) -> Column:
    """map<string,string> of the pattern's named groups."""
    expression, names = plain_groups(pattern)
    pairs = [c for i, n in enumerate(names, 1) if n for c in (F.lit(n), F.regexp_extract(path, expression, i))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
