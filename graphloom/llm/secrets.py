"""Secrets by fixed patterns and by the likelihood of formats that are learned from them.

One pass over the texts finds the base spans (assignments, access keys,
hexadecimal strings) and all candidates: stretches of credential characters of
``LEAST_CANDIDATE`` or more that touch no base span.  The values of the base
spans are credentials with a label.  Every different value of a kind is counted
in Spark over the states of a first automaton: the prefixes that one in
``FREQUENT`` values has, and behind them a grid of places and classes of the
last character, so what reaches the driver is bounded by states, not by rows.
States whose frequencies of next characters and ends differ no more than chance
allows (the Hoeffding bound, ``TAILS`` characters deep) are merged into a
probabilistic automaton.  Half of all candidates (by hash) stands for
everything else: those with letters give an automaton, and so do those without,
as numbers are rare and like hexadecimal digits.  Every candidate is scored by
its likelihood under the kinds' automata against these; what a kind's automaton
does not accept has none.  What exceeds the threshold, which the other half may
raise, is added as a span of its likeliest kind.  Credentials among the
candidates are few: less than one in a hundred do not move the threshold.

Nulls and edge cases: a null or empty text has no spans (the digest of
nothing, an empty list); texts are searched whole; rows are taken one by one,
so repeated rows have equal results and null ids stay; without values of a
kind, that kind adds nothing; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, drop_shared, materialize

#: The kinds in order, and their base patterns with the characters that they need.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
LEAST_HEX = 24
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
#: Characters that a candidate has at least; stretches of credential characters, ``=`` only at their end.
LEAST_CANDIDATE = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{12,}={0,2}")
#: A prefix of up to ``DEPTH`` characters is a state of its own if one in so many values has it; others share states by place, up to ``PLACES``.
FREQUENT, DEPTH, PLACES = 200, 8, 64
#: Characters ahead to which two states are compared.
TAILS = 3
#: Chance of keeping two states apart that are alike; strings that a state needs to be compared with others.
ALPHA, LEAST_SEEN = 0.01, 4
#: Different characters of candidates, and the weight of an even choice among them and the end in each state.
CHARACTERS, SMOOTH = 67, 0.5
#: Bits a character by which a candidate is likelier as a credential than as anything else, at least.
LEAST_SCORE, MARGIN = 1.5, 0.1
#: A candidate has so many times the length of its kind's shortest value, or more.
SHORTEST = 0.6
#: Groups that are counted besides the kinds: candidates with letters, and those without.
PLAIN, NUMBERS = len(KINDS), len(KINDS) + 1
#: Steps of a bit in which scores are counted for the threshold.
STEPS = 1000

FOUND = "doc_id long, base array<struct<kind: int, start: long, end: long>>, values array<struct<kind: int, value: string>>, candidates array<struct<start: long, value: string>>"


def spans_and_candidates(text: str) -> tuple[list[tuple[int, int, int, str]], list[tuple[int, str]]]:
    """The base spans (start, kind, end, value), by start, then kind; and (start, value) of the candidates that touch none."""
    base, found = [], []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        base += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        base += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    stretches = list(CANDIDATE.finditer(text))
    for m in stretches:  # hexadecimal strings lie within them
        if m.end() - m.start() >= LEAST_HEX:
            base += [(x.start(), 2, x.end(), x[0]) for x in HEX.finditer(text, m.start(), m.end())]
    base.sort()
    k, reach = 0, -1  # spans before k start before the candidate ends, and end at ``reach`` at most
    for m in stretches:
        value = m[0].strip(".")
        if len(value) < LEAST_CANDIDATE:
            continue
        start = m.start() + m[0].index(value)
        while k < len(base) and base[k][0] < start + len(value):
            reach = max(reach, base[k][2])
            k += 1
        if reach <= start:
            found.append((start, value))
    return base, found


def after(state: str, c: str, known) -> str:
    """The state behind a character: the longer prefix if it is ``known``, else the place and the class of the character."""
    if state[0] == "p":
        longer = state + c
        if longer in known:
            return longer
        place = len(longer) - 1
    else:
        place = int(state[2:]) + 1
    kind = "0" if c.isdigit() else "a" if "a" <= c <= "f" else "g" if "g" <= c <= "z" else "A" if "A" <= c <= "Z" else "-"
    return f"g{kind}{min(place, PLACES)}"


def states(value: str, known, steps: dict[tuple[str, str], str]) -> Iterator[tuple[str, str]]:
    """(state, next character) along a value, and its last state with no character; ``steps`` keeps what was found before."""
    s = "p"
    for c in value:
        key = s, c
        yield key
        s = steps.get(key)
        if s is None:
            s = steps[key] = after(*key, known)
    yield s, ""


class Automaton:
    """Probabilistic automaton of strings: a prefix tree, or states that were counted elsewhere, of which compatible ones are merged."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self._empty(1, alpha)
        for value in values:
            s = 0
            self.seen[0] += 1
            for c in value:
                self.passed[s][c] = self.passed[s].get(c, 0) + 1
                t = self.step[s].get(c)
                if t is None:
                    t = self.step[s][c] = len(self.step)
                    self.step.append({})
                    self.passed.append({})
                    self.ended.append(0)
                    self.seen.append(0)
                s = t
                self.seen[s] += 1
            self.ended[s] += 1
        self._merge_states()

    @classmethod
    def counted(cls, counts: list[tuple[str, str, int]], alpha: float = ALPHA) -> Automaton:
        """From how often strings went on from a state (see ``states``) with a character, or ended there (none)."""
        self = cls.__new__(cls)
        names = sorted({"p", *(s for s, _, _ in counts)}, key=lambda s: (s != "p", s))
        number = {s: k for k, s in enumerate(names)}
        self._empty(len(names), alpha)
        for s, c, n in sorted(counts):
            k = number[s]
            self.seen[k] += n
            if c:
                self.passed[k][c] = n
                self.step[k][c] = number[after(s, c, number)]
            else:
                self.ended[k] += n
        self._merge_states()
        return self

    def _empty(self, n: int, alpha: float) -> None:
        self.step: list[dict[str, int]] = [{} for _ in range(n)]
        self.passed: list[dict[str, int]] = [{} for _ in range(n)]
        self.ended, self.seen = [0] * n, [0] * n
        self.width = math.sqrt(0.5 * math.log(2 / alpha))

    def _now(self, s: int) -> int:
        """The state that ``s`` was merged into."""
        while self.into[s] != s:
            self.into[s] = s = self.into[self.into[s]]
        return s

    def _differs(self, a: int, na: int, b: int, nb: int) -> bool:
        return abs(a / na - b / nb) > self.width * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether what follows ``b`` could have the frequencies of what follows ``a``."""
        todo, met = [(a, b, TAILS)], set()
        while todo:
            a, b, left = todo.pop()
            a, b = self._now(a), self._now(b)
            na, nb = self.seen[a], self.seen[b]
            if min(na, nb) < LEAST_SEEN or a == b or (a, b, left) in met:
                continue
            met.add((a, b, left))
            if self._differs(self.ended[a], na, self.ended[b], nb):
                return False
            for c in self.passed[a].keys() | self.passed[b].keys():
                if self._differs(self.passed[a].get(c, 0), na, self.passed[b].get(c, 0), nb):
                    return False
                if left and c in self.step[a] and c in self.step[b]:
                    todo.append((self.step[a][c], self.step[b][c], left - 1))
        return True

    def _fold(self, a: int, b: int, kept: set[int]) -> None:
        """Merge ``b`` into ``a``, and what follows both by the same characters."""
        todo = [(a, b)]
        while todo:
            a, b = map(self._now, todo.pop())
            if a == b:
                continue
            if b in kept and a not in kept:
                a, b = b, a
            self.into[b] = a
            self.seen[a] += self.seen[b]
            self.ended[a] += self.ended[b]
            for c, n in self.passed[b].items():
                self.passed[a][c] = self.passed[a].get(c, 0) + n
            for c, t in self.step[b].items():
                if c in self.step[a]:
                    todo.append((self.step[a][c], t))
                else:
                    self.step[a][c] = t

    def _merge_states(self) -> None:
        self.into = list(range(len(self.step)))
        kept, order = [0], {0}
        while True:
            # the most frequent state that a kept one leads to is merged or kept next
            border = [(-self.seen[t], s, c, t) for s in kept for c, t in ((c, self._now(t)) for c, t in self.step[s].items()) if t not in order]
            if not border:
                break
            _, s, c, t = min(border)
            for k in (s, *reversed(kept)):  # a loop first, then the latest
                if self._compatible(k, t):
                    self._fold(k, t, order)
                    kept = [x for x in kept if self._now(x) == x]
                    order = set(kept)
                    break
            else:
                kept.append(t)
                order.add(t)
        number = {s: k for k, s in enumerate(kept)}
        self.step = [{c: number[self._now(t)] for c, t in self.step[s].items()} for s in kept]
        even = SMOOTH / CHARACTERS
        self.bits = [{c: math.log2((n + even) / (self.seen[s] + SMOOTH)) for c, n in self.passed[s].items()} for s in kept]
        self.unseen = [math.log2(even / (self.seen[s] + SMOOTH)) for s in kept]
        self.end_bits = [math.log2((self.ended[s] + even) / (self.seen[s] + SMOOTH)) for s in kept]
        del self.passed, self.ended, self.seen, self.into

    def score(self, value: str, strict: bool = False) -> float:
        """log2 of the probability of ``value``; after a character that was never seen, each choice is even, or there is none (strict)."""
        s, total = 0, 0.0
        for k, c in enumerate(value):
            t = self.step[s].get(c)
            if t is None:
                return -math.inf if strict else total + self.unseen[s] - (len(value) - k) * math.log2(CHARACTERS)
            total += self.bits[s][c]
            s = t
        return total + self.end_bits[s]


@dataclass
class Formats:
    """Automata of the kinds (number, automaton, least length) and of everything else, and the score from which a candidate is a secret."""

    kinds: list[tuple[int, Automaton, int]]
    plain: list[Automaton]
    threshold: float = LEAST_SCORE

    def best(self, value: str) -> tuple[float, int]:
        """Bits a character by which ``value`` is likelier as its likeliest kind than as anything else, and that kind."""
        scores = [(a.score(value, True), -k) for k, a, least in self.kinds if len(value) >= least]
        if not scores or max(scores)[0] == -math.inf:
            return -math.inf, 0
        score, k = max(scores)
        return (score - max(a.score(value) for a in self.plain)) / len(value), -k

    def kind_of(self, value: str) -> int | None:
        score, kind = self.best(value)
        return kind if score >= self.threshold else None


def learn(counts: list[tuple[int, str, str, int]], least: list[tuple[int, int]]) -> Formats:
    """Automata from counts (group, state, character, number) and the least length of each kind's values (kind, length)."""
    own = {g: [(s, c, n) for k, s, c, n in counts if k == g] for g in {k for k, *_ in counts}}
    kinds = [(k, Automaton.counted(own[k]), math.ceil(SHORTEST * n)) for k, n in sorted(least) if k in own]
    return Formats(kinds, [Automaton.counted(own[g]) for g in (PLAIN, NUMBERS) if g in own] or [Automaton([])])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans, their values, and candidates of every row (columns of FOUND)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(rows: list[list[tuple]], names: list[str], types: list) -> pa.Array:
            flat, ends = [x for r in rows for x in r], [0]
            for r in rows:
                ends.append(ends[-1] + len(r))
            columns = zip(*flat) if flat else [[] for _ in names]
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names))

        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                both = [spans_and_candidates(t) if t else ([], []) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), lists([[(k, s, e) for s, k, e, _ in base] for base, _ in both], ["kind", "start", "end"], [pa.int32(), pa.int64(), pa.int64()]),
                        lists([[(k, v) for _, k, _, v in base] for base, _ in both], ["kind", "value"], [pa.int32(), pa.string()]), lists([c for _, c in both], ["start", "value"], [pa.int64(), pa.string()]),
                    ],
                    names=["doc_id", "base", "values", "candidates"],
                )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, FOUND)


def fit(found: DataFrame) -> Formats:
    """Learn from all scanned rows, of equal values one; counts of states and scores reach the driver, whose number does not grow with the rows."""
    values = found.select(F.explode("values").alias("v")).select(F.col("v.kind").alias("g"), "v.value")
    plain = found.select(F.explode("candidates").alias("v")).select(F.when(F.col("v.value").rlike("[A-Za-z]"), PLAIN).otherwise(NUMBERS).alias("g"), "v.value")
    every = materialize(values.union(plain).distinct(), "secret-values", source=found)
    held = (F.col("g") >= PLAIN) & (F.pmod(F.xxhash64("value", F.lit("formats")), F.lit(2)) == 1)
    own = every.where(~held)
    groups = {r.g: r for r in own.groupBy("g").agg(F.count("*").alias("n"), F.min(F.length("value")).alias("least")).collect()}
    if not any(k in groups for k in range(len(KINDS))):
        drop_shared(found.sparkSession, every)
        return learn([], [])
    least_n = F.coalesce(*(F.when(F.col("g") == g, max(LEAST_SEEN, -(-r.n // FREQUENT))) for g, r in groups.items()))
    prefixes = own.select("g", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("value"), F.lit(DEPTH))), lambda k: F.substring("value", F.lit(1), k))).alias("prefix"))
    known: dict[int, set[str]] = {g: {"p"} for g in groups}
    for r in prefixes.groupBy("g", "prefix").count().where(F.col("count") >= least_n).collect():
        known[r.g].add("p" + r.prefix)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        steps: dict[int, dict] = {g: {} for g in known}
        for b in batches:
            for g, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n.update((g, s, c) for s, c in states(value, known[g], steps[g]))
        columns = zip(*((*key, x) for key, x in n.items())) if n else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64()))], names=["g", "state", "c", "n"])

    counts = own.mapInArrow(count, "g int, state string, c string, n long").groupBy("g", "state", "c").agg(F.sum("n")).collect()
    formats = learn([tuple(r) for r in counts], [(g, r.least) for g, r in groups.items() if g < PLAIN])
    low = LEAST_SCORE - MARGIN  # scores below do not move the threshold

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for b in batches:
            n.update(math.ceil(STEPS * max(low, formats.best(v)[0])) for v in b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], names=["score", "n"])

    scores = sorted(((r.score, r.n) for r in every.where(held).select("value").mapInArrow(score, "score long, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()), reverse=True)
    above = sum(n for _, n in scores) // 100
    for at, n in scores:
        if above < n:
            formats.threshold = max(LEAST_SCORE, at / STEPS + MARGIN)
            break
        above -= n
    drop_shared(found.sparkSession, every)
    return formats


def find_secrets(docs: DataFrame, formats: Formats | None = None, **columns) -> DataFrame:
    """doc_id, base and spans of every row: arrays of (start, kind, end), by start, then kind; spans has the base spans and those added.

    ``formats``: learned before; else they are learned from the base spans of ``docs``.
    """
    found = materialize(scan(docs, **columns), "secrets-found", source=docs)
    formats = formats or fit(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = [], [0]
            for row in b.column(1).to_pylist():
                flat += [(c["start"], kind, c["start"] + len(c["value"])) for c in row if (kind := formats.kind_of(c["value"])) is not None]
                ends.append(len(flat))
            columns = zip(*flat) if flat else [[]] * 3
            added = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()))], names=["start", "kind", "end"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), added)], names=["doc_id", "base", "added"])

    span = "array<struct<start: long, kind: int, end: long>>"
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base")
    both = found.select("doc_id", "candidates", base).mapInArrow(run, f"doc_id long, base {span}, added {span}")
    return both.select("doc_id", "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir))
    name = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))
