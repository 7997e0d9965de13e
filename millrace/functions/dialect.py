"""RE2-style patterns, number texts and literals for Spark expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMED = re.compile(r"\((?:\?P?<([A-Za-z_]\w*)>|(?!\?))")

#: Texts that count as numbers.
NUMBER = r"(?i)^([+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?|[+-]?inf(inity)?|nan)$"


def plain_groups(pattern: str) -> tuple[str, list[str]]:
    """The pattern with numbered groups only, and the name of each group ('' for none)."""
    names: list[str] = []
    out, at, in_class = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(" and (m := _NAMED.match(pattern, at)):
            names.append(m[1] or "")
            out.append("(")
            at = m.end()
            continue
        out.append(c)
        at += 1
    return "".join(out), names


def quoted(text: str) -> str:
    """A regular expression for the text itself."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)


def number(text: Column) -> Column:
    """A double; null where the text is not a number."""
    # The cast also takes "inf", "infinity" and "nan", but blanks around and letters after numbers too.
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def captures(text: Column, pattern: str, count: int) -> Column:
    """array(whole match, group 1, ...) of the first match."""
    return F.array(*[F.regexp_extract(text, pattern, i) for i in range(count + 1)])
