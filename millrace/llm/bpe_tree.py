"""Byte-level BPE by monoid tree reduction.

A segment of text is held with its pattern matches and the token ids it has on its own.
Segments form a monoid: a text is halved down to leaves of LEAF_CHARS characters, a few
matches each, and neighbours are joined by encoding a window around the border again.
Two kinds of border occur, and each window grows until what lies outside provably stays:

* Between pattern matches. Between a character and white space after it nothing is
  opened: every match ends there. Else the last matches of the left segment are opened
  until three characters have been: a match after which three more characters of its segment follow
  is final, for every alternative of the pattern looks at most at the next character,
  the contractions at the next three. From there the text is matched again, until a
  match ends where one of the right segment does; from there both see the same text.
* Between tokens, inside one match too long for a leaf. A token row is the BPE
  encoding if and only if every two neighbours, encoded together, give just these
  two (a first merge across a border would also happen in that pair alone). So the
  window may stop where both of its ends pass this pair test. A match that reaches
  over the border is joined from its two parts where each is one match of its segment.

The matches of a leaf are themselves reduced from LEAF_BYTES bytes on in this second
way; different matches of a leaf's size are remembered. Decoding joins the bytes of
halves.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import blocks, texts

#: Characters of a leaf, bytes of a leaf inside a match, ids of a leaf that is decoded.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 128, 64, 1024
LOOKAHEAD = 3
#: Different matches of a leaf that a worker remembers.
REMEMBERED = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@dataclass(slots=True)
class Segment:
    """Matches of a piece of text: characters of each, bytes of ids of each, and the ids as little-endian unsigned 32-bit integers."""

    sizes: array
    widths: array
    ids: bytearray


class Remembered(dict):
    """Ids by match, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, match: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[match] = self.make(match)
        return found


class TreeEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.ranks, self.leaf_chars, self.leaf_bytes = ranks, max(1, leaf_chars), max(1, leaf_bytes)
        self.base = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.of_bytes: dict[bytes, list[int]] = {}
        self.of_match = Remembered(self.match_ids)

    # tokens inside one match

    def merge(self, raw: bytes) -> list[int]:
        """Merges of raw alone, lowest rank first, leftmost first among equals."""
        if raw not in self.ranks:
            return self.base._encode_single_piece(raw)
        if (found := self.of_bytes.get(raw)) is None:
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while len(parts) > 1:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
                if rank == 1 << 40:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self.of_bytes[raw] = [self.ranks[p] for p in parts]
        return found

    def settled(self, left: int, right: int) -> bool:
        return self.merge(self.token[left] + self.token[right]) == [left, right]

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            window = self.merge(b"".join(map(self.token.__getitem__, left[-i:] + right[:j])))
            fits_left = i == len(left) or self.settled(left[-i - 1], window[0])
            fits_right = j == len(right) or self.settled(window[-1], right[j])
            if fits_left and fits_right:
                return left[:-i] + window + right[j:]
            i = i if fits_left else min(2 * i, len(left))
            j = j if fits_right else min(2 * j, len(right))

    def tokens(self, raw: bytes) -> list[int]:
        level = [self.merge(raw[i : i + self.leaf_bytes]) for i in range(0, len(raw), self.leaf_bytes)]
        while len(level) > 1:
            level = [self.join_tokens(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def match_ids(self, match: str) -> bytes:
        raw = match.encode()
        whole = self.ranks.get(raw)
        return array("I", self.tokens(raw) if whole is None else [whole]).tobytes()

    # segments of a text

    def leaf(self, text: str, start: int, end: int) -> Segment:
        found = self.pattern.findall(text, start, end)
        ids = list(map(self.of_match.__getitem__, found))
        return Segment(array("I", map(len, found)), array("I", map(len, ids)), bytearray().join(ids))

    def join(self, text: str, middle: int, end: int, left: Segment, right: Segment) -> Segment:
        """left, which ends at middle, and right, which ends at end, as one segment; left is used up."""
        sizes, widths, ids = left.sizes, left.widths, left.ids
        window, opened = middle, {}
        # Before white space every match of the left segment is final, unless it is white space too.
        if not text[middle].isspace() or text[middle - 1].isspace():
            at = len(ids)
            while sizes and middle - window < LOOKAHEAD:
                start, first = window - sizes.pop(), at - widths.pop()
                opened[start, window] = bytes(ids[first:at])
                window, at = start, first
            del ids[at:]
        k, border, remembered, most = 0, middle, self.of_match, self.leaf_chars
        if window < middle:
            for m in self.pattern.finditer(text, window, end):
                start, stop = m.span()
                fresh = k == 0
                while border < stop:
                    border += right.sizes[k]
                    k += 1
                if stop - start <= most:
                    found = remembered[m.group()]
                elif (found := opened.get((start, stop))) is None:
                    if fresh and k == 1 and border == stop and (start, middle) in opened:
                        two = (array("I", part).tolist() for part in (opened[start, middle], bytes(right.ids[: right.widths[0]])))
                        found = array("I", self.join_tokens(*two)).tobytes()
                    else:
                        found = self.match_ids(m.group())
                sizes.append(stop - start)
                widths.append(len(found))
                ids += found
                if border == stop >= middle:
                    break
        if k:
            ids += right.ids[sum(right.widths[:k]) :]
            sizes += right.sizes[k:]
            widths += right.widths[k:]
        else:
            ids += right.ids
            sizes += right.sizes
            widths += right.widths
        return left

    def segment(self, text: str, start: int, end: int) -> Segment:
        if end - start <= self.leaf_chars:
            return self.leaf(text, start, end)
        middle = (start + end) // 2
        return self.join(text, middle, end, self.segment(text, start, middle), self.segment(text, middle, end))

    def encode(self, text: str) -> bytes:
        """Ids of text as little-endian unsigned 32-bit integers."""
        return bytes(self.segment(text, 0, len(text)).ids)

    def decode(self, packed: bytes) -> bytes:
        if len(packed) <= 4 * LEAF_IDS:
            return b"".join(map(self.token.__getitem__, array("I", packed)))
        half = len(packed) // 8 * 4
        return self.decode(packed[:half]) + self.decode(packed[half:])


_encoders: dict[tuple, TreeEncoder] = {}


def encoder(ranks: dict[bytes, int], pattern: str, key: tuple) -> TreeEncoder:
    """One encoder for each Python worker and vocabulary."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = TreeEncoder(ranks, pattern)
    return _encoders[key]


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary) of every row's whole text.

    ranks_path: a file of base64 tokens and ranks on the driver, about 1 MB whatever
    the corpus, broadcast to the executors. Rows are encoded where they are read,
    without a shuffle. A null or empty text gives no ids; a null doc_id stays null;
    repeated rows each give a row; other columns are ignored.
    """
    docs = texts(docs)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    key = (ranks_path, pattern)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(ranks.value, pattern, key)
        for batch in batches:
            for start, stop in blocks(pc.binary_length(batch.column("text")).to_pylist()):
                part = batch.slice(start, stop - start)
                ids = [tree.encode(t) for t in part.column("text").to_pylist()]
                decoded = [tree.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.mapInArrow(encode, "doc_id long, n_tokens long, ids binary, decoded binary")


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of what bpe_round_trip gives."""
    return bpe_round_trip(docs, ranks_path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
