"""Secret scan with inferred credential formats.

Base detectors find assignments, access keys and hex digests by pattern. Their finds
are the labelled credentials from which a probabilistic automaton per kind is inferred.
The prefix tree of a bounded sample is merged in two passes, each while next-symbol and
end frequencies, here and further on, agree within Hoeffding's bound:

* States of one depth first. Random symbols leave each branch with one string, so only
  together do the branches show what stands at a position and where a format ends.
* Then states of different depths, where both have been seen often enough to tell. A
  format of any length gets its loops this way; one of fixed length keeps its chain.

Every other run of eight or more symbols of values in every text is then scored by each
automaton. A token is a secret of a format if it ends where credentials end, its
likelihood per symbol is among those that credentials have under automata that did not
see them, and above that of the plain tokens. A format is read in either letter case.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import texts

# Kinds in listing order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_CHARS = 8

#: Every whole run of the symbols of an assigned value, from its least length on.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % ASSIGN_CHARS)
LEARNED = tuple(f"{k}_format" for k in KINDS)
#: Bounds on what the driver learns from: credentials of a kind, and plain tokens; symbols of all of them, which bound the states.
SAMPLE, SYMBOLS = 300, 1 << 17
#: Distinct tokens whose kinds a task remembers, and their longest.
REMEMBERED, REMEMBERED_CHARS = 100_000, 64
SALTS = 16
ALPHA = 0.05
#: Strings that must have passed both states for a merge over depths.
EVIDENCE = 30
#: A candidate is taken above this quantile of the likelihoods of credentials held out in turn, in FOLDS parts.
QUANTILE, FOLDS = 0.01, 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind position, end) of the base detectors' finds, leftmost and without overlap within each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def credential(text: str, start: int, kind: int, end: int) -> str:
    """The secret itself of a find."""
    return ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]


@dataclass
class State:
    seen: int = 0
    ends: int = 0
    next: dict[str, int] = field(default_factory=dict)
    taken: dict[str, int] = field(default_factory=dict)


class Automaton:
    """A deterministic probabilistic automaton inferred from sample strings."""

    def __init__(self, sample: list[str], alpha: float = ALPHA):
        self.states, levels = [State()], [[0]]
        for text in sample:
            at = 0
            for depth, c in enumerate(text, 1):
                state = self.states[at]
                state.seen += 1
                state.taken[c] = state.taken.get(c, 0) + 1
                if c not in state.next:
                    state.next[c] = len(self.states)
                    self.states.append(State())
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append(state.next[c])
                at = state.next[c]
            self.states[at].seen += 1
            self.states[at].ends += 1
        self.merged = list(range(len(self.states)))
        self.apart: set[tuple[int, int]] = set()
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.symbols = max(2, len({c for t in sample for c in t}))
        for level in levels:
            self._settle([], level, 0)
        self.red = [0]
        for level in levels:
            self._settle(self.red, level, EVIDENCE)
        self._freeze()

    def _of(self, i: int) -> int:
        """The state that i has become."""
        while self.merged[i] != i:
            self.merged[i] = i = self.merged[self.merged[i]]
        return i

    def _settle(self, heads: list[int], states: list[int], evidence: int) -> None:
        """Merges each state that `evidence` strings have passed into the first compatible head, or makes it one."""
        for i in dict.fromkeys(map(self._of, states)):
            if (i := self._of(i)) in heads or self.states[i].seen < evidence:
                continue
            for head in heads:
                if self._compatible(head, i):
                    self._merge(head, i)
                    break
            else:
                heads.append(i)

    def _compatible(self, a: int, b: int) -> bool:
        """True if no frequency after a and b differs by more than chance.

        Where so few strings have passed that no difference could tell, neither could what follows.
        """
        todo, led = [(a, b)], {(a, b): None}
        while todo:
            pair = todo.pop()
            if pair in self.apart or self._differ(*(self.states[i] for i in pair)):
                # So do all pairs on the way to it.
                while pair:
                    self.apart.add(pair)
                    pair = led[pair]
                return False
            x, y = (self.states[i] for i in pair)
            if self._chance(x, y) < 1:
                for c in x.next.keys() & y.next.keys():
                    after = self._of(x.next[c]), self._of(y.next[c])
                    if after[0] != after[1] and after not in led:
                        led[after] = pair
                        todo.append(after)
        return True

    def _chance(self, x: State, y: State) -> float:
        return self.bound * (1 / math.sqrt(x.seen) + 1 / math.sqrt(y.seen)) if x.seen and y.seen else 1.0

    def _differ(self, x: State, y: State) -> bool:
        chance = self._chance(x, y)
        if chance >= 1:
            return False
        if abs(x.ends / x.seen - y.ends / y.seen) > chance:
            return True
        return any(abs(n / x.seen - y.taken.get(c, 0) / y.seen) > chance for c, n in x.taken.items()) or any(n / y.seen > chance for c, n in y.taken.items() if c not in x.taken)

    def _merge(self, a: int, b: int) -> None:
        """Makes b a part of a, and what follows b part of what follows a."""
        self.apart.clear()
        todo = [(a, b)]
        while todo:
            i, j = map(self._of, todo.pop())
            if i == j:
                continue
            i, j = min(i, j), max(i, j)
            self.merged[j] = i
            x, y = self.states[i], self.states[j]
            x.seen += y.seen
            x.ends += y.ends
            for c, n in y.taken.items():
                x.taken[c] = x.taken.get(c, 0) + n
                if c in x.next:
                    todo.append((x.next[c], y.next[c]))
                else:
                    x.next[c] = y.next[c]

    def _freeze(self) -> None:
        """Logarithms of all steps and ends. An unseen symbol is rare and leads where most strings went."""
        alive = {i: k for k, i in enumerate(dict.fromkeys(map(self._of, range(len(self.states)))))}
        self.red = sorted({self._of(i) for i in self.red})
        self.rare = math.log(1 / (20 * self.symbols))
        self.steps: list[dict[str, tuple[float, int]]] = []
        self.most: list[int | None] = []
        self.end: list[float] = []
        for i in alive:
            state = self.states[i]
            self.steps.append({c: (max(self.rare, math.log(n / state.seen)), alive[self._of(state.next[c])]) for c, n in state.taken.items()})
            self.most.append(alive[self._of(state.next[max(state.taken, key=state.taken.get)])] if state.taken else None)
            self.end.append(max(self.rare, math.log(state.ends / state.seen)) if state.ends else -math.inf)
        del self.states, self.merged, self.apart

    def likelihood(self, text: str, least: float = -math.inf) -> float:
        """Mean log-likelihood of the symbols of text and its end; -inf where no string ends, or if it is below least."""
        at, total, floor = 0, 0.0, least * (len(text) + 1)
        for c in text:
            if (step := self.steps[at].get(c)) is not None:
                total += step[0]
                at = step[1]
            elif self.most[at] is not None:
                total += self.rare
                at = self.most[at]
            else:
                return -math.inf
            if total < floor:
                return -math.inf
        total += self.end[at]
        return total / (len(text) + 1) if total >= floor else -math.inf


def views(token: str) -> tuple[str, ...]:
    """The token, and in the other case where its letters are all of one."""
    return (token, token.swapcase()) if token.islower() or token.isupper() else (token,)


@dataclass
class Formats:
    """Automata with their thresholds by kind, and the automaton of plain tokens."""

    of_kind: list[tuple[int, Automaton, float]]
    plain: Automaton | None
    known: dict[str, int | None] = field(default_factory=dict)

    def kind_of(self, token: str) -> int | None:
        """classify, remembering short tokens: most are words of the language."""
        if len(token) > REMEMBERED_CHARS:
            return self.classify(token)
        if token not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[token] = self.classify(token)
        return self.known[token]

    def classify(self, token: str) -> int | None:
        """The likeliest kind that takes the token."""
        seen = views(token)
        scores = [(score, kind) for kind, automaton, least in self.of_kind if (score := max(automaton.likelihood(v, least) for v in seen)) > -math.inf]
        if not scores or self.plain and max(map(self.plain.likelihood, seen)) >= max(scores)[0]:
            return None
        return max(scores)[1]


def bounded(sample: list[str]) -> list[str]:
    """The strings, of any length, that SYMBOLS symbols hold, taken in order; one that no longer fits makes room for the next."""
    out, left = [], SYMBOLS
    for text in sample:
        if len(text) <= left:
            out.append(text)
            left -= len(text)
    return out


def learn(samples: dict[str, list[str]]) -> Formats:
    of_kind = []
    for k, kind in enumerate(KINDS):
        sample = bounded(samples.get(kind, []))
        if len(sample) >= FOLDS:
            held_out = []
            for i, j in pairwise(len(sample) * f // FOLDS for f in range(FOLDS + 1)):
                others = Automaton(sample[:i] + sample[j:])
                held_out += [others.likelihood(t) for t in sample[i:j]]
            # A length that only the held-out part has says nothing of the symbols.
            scores = sorted(x for x in held_out if x > -math.inf)
            if scores:
                of_kind.append((k, Automaton(sample), scores[int(QUANTILE * len(scores))] - 1e-9))
    plain = bounded(samples.get("plain", []))
    return Formats(of_kind, Automaton(plain) if plain else None)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[re.Match]:
    """Candidates that no base span (in order of starts) overlaps."""
    k, reach = 0, -1
    for m in CANDIDATE.finditer(text):
        while k < len(base) and base[k][0] < m.end():
            reach = max(reach, base[k][2])
            k += 1
        if reach <= m.start():
            yield m


def labelled(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """At most `sample` credentials of each kind and plain tokens, different ones in hash order, from all documents."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, set[str]] = defaultdict(set)
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                for start, kind, end in spans:
                    found[KINDS[kind]].add(credential(text, start, kind, end).rstrip("."))
                found["plain"].update(m.group() for m in candidates(text, spans))
            rows = [(h, kind, t) for kind, values in found.items() for h, t in sorted((int.from_bytes(hashlib.blake2b(t.encode(), digest_size=7).digest(), "big"), t) for t in values)[:sample]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))], ["h", "kind", "value"])

    # A batch sends `sample` rows of a kind at most; of each salt of a kind as many stay.
    rows = docs.mapInArrow(gather, "h long, kind string, value string").distinct()
    order = Window.partitionBy("kind", F.col("h") % SALTS).orderBy("h", "value")
    few = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).select("h", "kind", "value").toPandas()
    return {kind: part.sort_values(["h", "value"])["value"].tolist()[:sample] for kind, part in few.groupby("kind")}


def all_spans(text: str, formats: Formats) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those with what the formats add; kinds count on from the base kinds.

    Full stops at the end of a candidate belong to it only if it is taken with them.
    """
    base = base_spans(text)
    more = []
    for m in candidates(text, base):
        for token in dict.fromkeys((m.group(), m.group().rstrip("."))):
            if len(token) >= ASSIGN_CHARS and (kind := formats.kind_of(token)) is not None:
                more.append((m.start(), len(KINDS) + kind, m.start() + len(token)))
                break
    return base, sorted(base + more)


def listed(spans: list[tuple[int, int, int]]) -> str:
    names = KINDS + LEARNED
    return ",".join(f"{names[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned: one row for each row of docs.

    Spans are kind:start:end in code points, end exclusive, by start and then kind; base
    spans stay whatever the formats add. A null or empty text has none; without
    credentials to learn from, nothing is added; repeated rows each give a row; other
    columns are ignored. Texts are read twice, once to learn and once to scan; nothing
    but the samples leaves the tasks.
    """
    docs = texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(labelled(docs, sample)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text, formats)
                n = [sum(kind == k for _, kind, _ in base) for k in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), len(spans) - len(base)))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((*[pa.int64()] * 3, pa.string(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"])

    return docs.mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long")
