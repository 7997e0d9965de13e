"""Offset-mapped token counts: which section of a text each token belongs to.

A whole text is encoded once. Token byte lengths give byte offsets, and those give
character spans: from the character that holds the token's first byte to the end of
the one that holds its last. Spans are joined to the sections of the text by binary
search, and a token that crosses a border goes to one section by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe_tree import TreeEncoder, encoder, read_ranks
from millrace.llm.common import blocks

RULES = ("largest", "first", "last")


class OffsetEncoder:
    """Character spans of the tokens of whole texts, encoded by tree reduction as in bpe_tree."""

    def __init__(self, tree: TreeEncoder):
        self.tree = tree
        self.size = np.zeros(max(tree.token) + 1, np.int64)
        for i, raw in tree.token.items():
            self.size[i] = len(raw)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in characters, of the tokens of text."""
        stops = np.cumsum(self.size[np.frombuffer(self.tree.encode(text), np.uint32)])
        starts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(text):
            return starts, stops
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[starts], char[stops - 1] + 1


def lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections of a text by default: its lines with their line ends."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.nonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10)[0] + 1
    stops = breaks if len(breaks) and breaks[-1] == len(text) else np.append(breaks, len(text))
    return np.concatenate([[0], stops[:-1]]), stops


def in_order(given: list[dict | None], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, start, end) of the sections given for a text of so many characters, in order and without overlap.

    A section that is null or has a null start or end is none. The others are cut to the
    text, ordered by start and end, and begin where the ones before them end; what is
    left of one may be empty. number: its place among those given.
    """
    known = sorted((max(0, s["start"]), s["end"], k) for k, s in enumerate(given) if s is not None and s["start"] is not None and s["end"] is not None)
    out, upto = [], 0
    for start, end, k in known:
        start = min(max(start, upto), length)
        upto = max(start, min(end, length))
        out.append((k, start, upto))
    return tuple(np.array([x[c] for x in out], np.int64) for c in range(3))


def reached(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last section that each token has a part in; none: the first is after the last."""
    return np.searchsorted(end, token_start, "right"), np.searchsorted(start, token_end, "left") - 1


def cut_off(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of the tokens in some section, those that reach out of one."""
    some = np.nonzero(first <= last)[0]
    return (first[some] < last[some]) | (token_start[some] < start[first[some]]) | (token_end[some] > end[last[some]])


def allocate(token_start: np.ndarray, token_end: np.ndarray, start: np.ndarray, end: np.ndarray, rule: str = "largest") -> np.ndarray:
    """The section of each token, -1 where none has a part of it.

    Sections are in order and do not overlap. A token in two or more goes to the one
    with the largest part of it, the first of equals (rule largest), or to the first or
    the last of them.
    """
    if not len(start):
        return np.full(len(token_start), -1)
    first, last = reached(token_start, token_end, start, end)
    owner = np.where(first <= last, first, -1)
    crossing = np.nonzero(first < last)[0]
    if rule == "last":
        owner[crossing] = last[crossing]
    elif rule == "largest":
        for k in crossing:
            some = slice(first[k], last[k] + 1)
            owner[k] = first[k] + int(np.argmax(np.minimum(end[some], token_end[k]) - np.maximum(start[some], token_start[k])))
    return owner


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, sections: str | None = None, rules: Sequence[str] = ("largest",)) -> DataFrame:
    """doc_id, section, start, end, n_crossing and n_tokens_<rule> for each rule: one row for each section of each row's text.

    sections: the name of a column array<struct<start, end>> in characters, or None for
    lines, each with its line end. Sections are put in order: null ones and ones with a
    null start or end are left out, others are cut to the text and to what no earlier one
    has, see in_order; section is the place in the array. rules: where a token goes that reaches over a border, see
    allocate. Tokens outside all sections are in a row with section null. n_crossing:
    tokens that reach into the section and out of it. Counts of a row by one rule add
    up to the tokens of its whole text. A null or empty text has no sections and no
    rows; a null sections value means no section; repeated rows each give their rows;
    other columns are ignored.
    """
    if not rules or set(rules) - set(RULES):
        raise ValueError(f"rules must be some of {RULES}")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = (ranks_path, pattern)
    spans = "array<struct<start:bigint,end:bigint>>"
    given = F.lit(None).cast(spans) if sections is None else F.transform(F.coalesce(docs[sections], F.array().cast(spans)), lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), given.alias("sections"))
    names = ["doc_id", "section", "start", "end", "n_crossing", *(f"n_tokens_{rule}" for rule in rules)]

    def counts(encoder: OffsetEncoder, text: str, own: list | None) -> list[np.ndarray]:
        """Columns from section on of one text; section -1 is none."""
        if own is None:
            start, end = lines(text)
            number = np.arange(len(start))
        else:
            number, start, end = in_order(own, len(text))
        # Row 0 is for tokens in no section; empty sections have none.
        row = np.concatenate([[0], np.nonzero(start < end)[0] + 1])
        token_start, token_end = encoder.spans(text)
        full = start[row[1:] - 1], end[row[1:] - 1]
        by_rule = [np.bincount(row[allocate(token_start, token_end, *full, rule) + 1], minlength=len(start) + 1) for rule in rules]
        over = np.zeros(len(start) + 1, np.int64)
        first, last = reached(token_start, token_end, *full)
        # A token that stands partly in sections crosses into each that it reaches.
        for k in np.nonzero(first <= last)[0][cut_off(token_start, token_end, *full, first, last)]:
            over[row[first[k] + 1 : last[k] + 2]] += 1
        at = np.arange(0 if by_rule[0][0] else 1, len(start) + 1)
        return [np.concatenate([[-1], number])[at], np.concatenate([[0], start])[at], np.concatenate([[0], end])[at], over[at], *(n[at] for n in by_rule)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = OffsetEncoder(encoder(ranks.value, pattern, key))
        for whole in batches:
            for at, stop in blocks(pc.binary_length(whole.column("text")).to_pylist()):
                batch = whole.slice(at, stop - at)
                ids, found = [], []
                for doc_id, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "sections")), strict=True):
                    if text:
                        found.append(counts(offsets, text, own))
                        ids += [doc_id] * len(found[-1][0])
                columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * (len(names) - 1)
                none = columns[0] < 0
                arrays = [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64(), mask=none) for c in columns[:3]), *(pa.array(c, pa.int64()) for c in columns[3:])]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(count, ", ".join(f"{name} long" for name in names))
