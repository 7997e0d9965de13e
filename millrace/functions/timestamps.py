"""Event times of log lines, as timestamps. The session time zone must be UTC."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions import expressions
from millrace.functions.expressions import Scope

# Tokens of reference-time layouts, longest first, and their Java patterns.
_TOKENS = {
    "January": "MMMM", "Monday": "EEEE", "Z07:00": "XXX", "-07:00": "xxx", "Z0700": "XX", "-0700": "xx", "2006": "yyyy", ".000": ".SSS", "MST": "z",
    "Jan": "MMM", "Mon": "EEE", "_2": "d", "01": "MM", "02": "dd", "03": "hh", "04": "mm", "05": "ss", "06": "yy", "15": "HH", "PM": "a", "1": "M", "2": "d", "3": "h", "4": "m", "5": "s",
}
_TOKEN = re.compile("|".join(re.escape(t) for t in _TOKENS))

#: Up to so many characters may stand before a detected time.
MAX_OFFSET = 4
_MAIN = r"^.{0,4}?(\d{4}([-/])\d{2}\2\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{3})?(?: ?(?:Z|[+-]\d{2}:\d{2}))?)"
_MONTH = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_DAY = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
_CLOCK = r"(\d{2}:\d{2}:\d{2})"
#: Other layouts, and how their groups make 2006-Jan-02 15:04:05 with what follows it.
_OTHERS = (
    (rf"(\d{{2}})/({_MONTH})/(\d{{4}})[: ]{_CLOCK}(?: (Z|[+-]\d{{4}}))?", "$3-$2-$1 $4$5"),
    (rf"(\d{{4}}) ({_MONTH})/(\d{{2}}) {_CLOCK}", "$1-$2-$3 $4"),
    (rf"({_MONTH}) (\d{{2}}) (\d{{4}}) {_CLOCK}", "$3-$1-$2 $4"),
    (rf"(?:{_DAY}) ({_MONTH}) +(\d{{1,2}}) {_CLOCK} (UTC |GMT |[A-Z]{{3,4}} )?(\d{{4}})", "$5-$1-$2 $3$4"),
    (rf"(\d{{2}})/(\d{{2}})/(\d{{4}}) {_CLOCK}", "$3-$1-$2 $4"),
)


def java_pattern(layout: str) -> str:
    """A reference-time layout as a Java pattern."""
    out, at = [], 0
    for m in _TOKEN.finditer(layout):
        out += [re.sub(r"([A-Za-z]+)", r"'\1'", layout[at : m.start()]), _TOKENS[m[0]]]
        at = m.end()
    return "".join(out) + re.sub(r"([A-Za-z]+)", r"'\1'", layout[at:])


def _local(moment: Column, zone: str | None) -> Column:
    return F.to_utc_timestamp(moment, zone) if zone else moment


@dataclass(frozen=True)
class Seen:
    """What a sample of lines shows of their times: which of the ways to write one occur, and where a numeric date stands if it is always the same place."""

    ways: frozenset[str] = frozenset(("date", "other", "epoch"))
    start: int | None = None
    size: int | None = None
    signs: str = "/T,"


def seen_in(lines: list[str]) -> Seen:
    """The layouts of some lines; without any known one, all may follow."""
    ways, places = set(), set()
    for line in lines:
        if m := re.match(_MAIN, line):
            ways.add("date")
            places.add((m.start(1), m.end(1), re.sub(r"\d", "0", m[1])))
        elif any(re.match("^.{0,4}?" + pattern, line) for pattern, _ in _OTHERS):
            ways.add("other")
        elif re.match(r"^(\d{13}|\d{10})[^\d]", line):
            ways.add("epoch")
    if not ways:
        return Seen()
    if ways == {"date"} and len(places) == 1 and not re.search(" (Z|[+-])", (place := places.pop())[2]):
        return Seen(frozenset(ways), place[0], place[1] - place[0], "".join(c for c in "/T," if c in place[2]))
    return Seen(frozenset(ways))


def auto(line: Column, zone: str | None = None, seen: Seen | None = None) -> Column:
    """The time near the start of a line in any of the known layouts, or its leading epoch digits; NULL if there is none.

    Times without a zone are in `zone`, UTC by default. seen: the layouts that most lines
    have, which are tried first; a line that has none of them is read in any layout.
    """
    if seen is None or seen == Seen():
        return _auto(line, zone, Seen())
    # Through a one-element array, so that the code of the other layouts stays apart and runs for the lines that are left only.
    return F.coalesce(_auto(line, zone, seen), F.transform(F.array(line), lambda x: _auto(x, zone, Seen()))[0])


def _auto(line: Column, zone: str | None, seen: Seen) -> Column:
    found = []
    if "date" in seen.ways:
        found.append(_date(line, zone, seen))
    if "other" in seen.ways:
        found.append(_other(line, zone))
    if "epoch" in seen.ways:
        digits = F.regexp_extract(line, r"^(\d{13})[^\d]", 1), F.regexp_extract(line, r"^(\d{10})[^\d]", 1)
        found.append(F.when(digits[0] != "", F.timestamp_millis(digits[0].try_cast("long"))).when(digits[1] != "", F.timestamp_seconds(digits[1].try_cast("long"))))
    return F.coalesce(*found)


def _date(line: Column, zone: str | None, seen: Seen) -> Column:
    if seen.start is not None:
        main = F.substring(line, seen.start + 1, seen.size)
        zoned = main.rlike(r"(Z|[+-]\d{2}:\d{2})$")
        moment = (F.translate(main, seen.signs, "".join({"/": "-", "T": " ", ",": "."}[c] for c in seen.signs)) if seen.signs else main).try_cast("timestamp")
        # A cast takes shorter forms too; these are no times of a line.
        moment = F.when((F.length(main) == seen.size) & F.substring(main, 17, 1).eqNullSafe(":"), moment)
        return F.when(zoned, moment).otherwise(_local(moment, zone)) if zone else moment
    main = F.translate(F.regexp_replace(F.regexp_extract(line, _MAIN, 1), r" (Z|[+-]\d{2}:\d{2})$", "$1"), "/T,", "- .")
    moment = main.try_cast("timestamp")
    return F.when(main != "", F.when(main.rlike(r"(Z|[+-]\d{2}:\d{2})$"), moment).otherwise(_local(moment, zone)) if zone else moment)


def _other(line: Column, zone: str | None) -> Column:
    text = F.lit(None).cast("string")
    for pattern, order in reversed(_OTHERS):
        text = F.when(line.rlike("^.{0,4}?" + pattern), F.regexp_replace(F.regexp_extract(line, "^.{0,4}?(" + pattern + ")", 1), pattern, order)).otherwise(text)

    def resolve(found: Column) -> Column:
        local = F.regexp_replace(F.regexp_extract(found, r"^(\S+ [\d:]{8})", 1), r"-(\d)(?= )", "-0$1")
        there = F.coalesce(F.try_to_timestamp(local, F.lit("yyyy-MMM-dd HH:mm:ss")), F.try_to_timestamp(local, F.lit("yyyy-MM-dd HH:mm:ss")))
        offset = F.regexp_extract(found, r"([+-]\d{4})$", 1)
        minutes = F.substring(offset, 1, 3).try_cast("int") * 60 + F.concat(F.substring(offset, 1, 1), F.substring(offset, 4, 2)).try_cast("int")
        absolute = F.timestamp_seconds(F.unix_seconds(there) - 60 * F.coalesce(minutes, F.lit(0)))
        return F.when(found.rlike(r"(Z|UTC |GMT |[+-]\d{4})$"), absolute).otherwise(_local(there, zone))

    # Through a one-element array, so that the text is made once and the code stays small.
    return F.when(line.rlike(rf"{_MONTH}|^.{{0,4}}?\d\d/\d\d/\d{{4}} "), F.transform(F.array(text), resolve)[0])


def by_layout(value: Column, layout: str, zone: str | None = None) -> Column:
    """A time in a reference-time layout."""
    moment = F.try_to_timestamp(F.replace(value, F.lit(","), F.lit(".")) if ".000" in layout else value, F.lit(java_pattern(layout)))
    return moment if re.search(r"Z07|-07|MST", layout) else _local(moment, zone)


def event_time(conf: dict | None, scope: Scope, zone: str | None = None, now: Column | None = None, seen: Seen | None = None) -> Column:
    """The time of a record by a task's time configuration; NULL on error. seen: the layouts to try first where they are detected."""
    conf = conf or {}
    kind = conf.get("type") or "auto"
    zone = zone or conf.get("timezone") or None
    if kind == "processTime":
        return F.current_timestamp() if now is None else now
    if kind == "auto":
        return auto(scope.line, zone, seen)
    value = expressions.text(conf.get("elect"), scope)
    form = conf.get("format") or "auto"
    if form == "unix":
        return F.timestamp_seconds(F.when(value.rlike(r"^[+-]?\d{1,12}$"), value.try_cast("long")))
    if form == "unixMilli":
        return F.timestamp_millis(F.when(value.rlike(r"^[+-]?\d{1,15}$"), value.try_cast("long")))
    if form == "golangLayout":
        return by_layout(value, conf["layout"], zone)
    return auto(value, zone)


def usable(moment: Column) -> Column:
    """False for a missing time or one not after the epoch."""
    return F.coalesce(F.unix_micros(moment) > 0, F.lit(False))
