"""Toxicity after noisy-channel deobfuscation.

Writers hide words by leetspeak, spacing, separators and repeated letters.
Every token becomes a lattice: each character offers the letters it may stand
for, or nothing, at a channel cost.  A Viterbi search under a character
trigram model finds the cheapest reading; restored words are then scored.

Most readings cannot hold anything that counts.  Characters that may stand for
one another have one letter of a skeleton, and separators and repeats none, so
whatever a token may read as, its skeleton is the same.  Only tokens whose
skeleton contains that of a sign are searched (one automaton finds all); this
leaves out no sign, and a token of letters alone without repeats has one path,
its own spelling.

Learned from all labelled rows: the character model; words and word beginnings
that toxic texts have far more often than clean ones (the lower confidence
bound of their log odds); and a logistic regression on the total of a text's
different signs and on its length, whose weight for signs is never negative: a
worse word never lowers a score.  Counting and the sums of each step of the
regression run in Spark; the driver gets at most ``SIGNS`` signs and
``TRIGRAMS`` trigrams.

Nulls and edge cases: a null, empty or blank text has no signs and gets the
score of such texts; rows without a label are not learned from; with no label
of either class every score is 0; null ids count as not held out; rows or
labels that share an id count as one where they are learned from (the greater
label, the text of least hash), and so do rows with one text (the greater
label); repeated rows are scored alike; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import crc_mod, documents, drop_shared, materialize

#: Bounds of the model.
SIGNS = 20_000
TRIGRAMS = 50_000
#: Lower confidence bound (in natural log odds) from which a sign counts, and toxic texts that it needs.
LEAST_ODDS, LEAST_TEXTS = 1.0, 3
#: Beginnings of words that are signs too.
STEMS = (4, 5)
#: Readings that one worker keeps, and words and trigrams that it counts before it hands them on.
CACHE, COUNTED = 1_000_000, 300_000
#: What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SEPARATORS = " .-_*~'/\\,:;^`"
#: Costs of the channel, in natural log units.
SUBSTITUTED, DROPPED, CENSORED, KEPT_REPEAT, KEPT_MARK = 0.5, 0.3, 2.5, 1.5, 1.0

_WORD = re.compile(r"[^\W\d_]+")
_SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$€])(?:[ .\-_*~]{1,2}(?:[^\W_]|[@$€])){2,}(?!\S)")
#: One letter for what may stand for one another.
_SKELETON = str.maketrans({c: None for c in SEPARATORS} | {"l": "i", "|": "i"} | {c: "i" if s == "il" else s for c, s in LEET.items()})
_REPEATS = re.compile(r"(.)\1+", re.S)
_LETTERS = re.compile(r"[^\W\d_]+\Z")
#: Marks that stand for no letter: at a token's ends they change no reading.
_EDGES = ".,;:?)'\"-_~`^"


def skeleton(token: str) -> str:
    return _REPEATS.sub(r"\1", token.translate(_SKELETON))


@dataclass
class CharacterModel:
    """Interpolated trigrams over words written as ``##word#``."""

    counts: dict[str, int]
    two: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    mid: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    one: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    last: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    total: int = 0

    def __post_init__(self):
        for g, n in self.counts.items():
            self.two[g[:2]] += n
            self.mid[g[1:]] += n
            self.one[g[1]] += n
            self.last[g[2]] += n
            self.total += n
        self.memo: dict[str, float] = {}

    def cost(self, gram: str) -> float:
        """Negative log probability of a character after two others."""
        got = self.memo.get(gram)
        if got is None:
            p = 0.05 * (self.last.get(gram[2], 0) + 0.5) / (self.total + 100)
            if n := self.one.get(gram[1], 0):
                p += 0.25 * self.mid.get(gram[1:], 0) / n
            if n := self.two.get(gram[:2], 0):
                p += 0.7 * self.counts.get(gram, 0) / n
            got = self.memo[gram] = -math.log(p)
        return got


def trigrams(words: list[str]) -> Counter:
    out: Counter = Counter()
    for w in words:
        w = f"##{w}#"
        out.update(w[k : k + 3] for k in range(len(w) - 2))
    return out


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per character, what it may be read as (a letter, a word end ``#`` or nothing) and the channel's cost."""
    out = []
    for k, c in enumerate(token):
        options: list[tuple[str, float]] = []
        if c.isalpha():
            options.append((c, KEPT_REPEAT if k > 1 and token[k - 2 : k] == c * 2 else 0.0))
            if k and token[k - 1] == c:
                options.append(("", DROPPED if (k > 1 and token[k - 2] == c) or token[k + 1 : k + 2] == c else 1.0))
        for s in LEET.get(c, ""):
            options.append((s, SUBSTITUTED))
        if c in LEET and k and token[k - 1] == c:
            options.append(("", DROPPED))
        if c in SEPARATORS:
            options += [("", DROPPED), ("#", 0.0)]
        elif c in "!|+(" or (c in LEET and c.isdigit()):  # it may be what it is
            options.append(("#", KEPT_MARK))
        if c == "*":
            options += [(v, CENSORED) for v in "aeiou"]
        out.append(options or [("#", 0.0)])
    return out


def decode(token: str, model: CharacterModel) -> list[str]:
    """Words of the cheapest reading of a token's lattice."""
    states: dict[str, tuple[float, tuple | None]] = {"##": (0.0, None)}  # last two characters: cost, path
    for options in lattice(token):
        after: dict[str, tuple[float, tuple | None]] = {}
        for last, (cost, path) in states.items():
            for c, channel in options:
                if not c or (c == "#" and last[1] == "#"):
                    key, total, link = last, cost + channel, path
                else:
                    key, total, link = ("##" if c == "#" else last[1] + c), cost + channel + model.cost(last + c), (c, path)
                if key not in after or total < after[key][0]:
                    after[key] = (total, link)
        states = after
    _, path = min(((cost + (0 if last[1] == "#" else model.cost(last + "#")), path) for last, (cost, path) in states.items()), key=lambda x: x[0])
    chars = []
    while path:
        chars.append(path[0])
        path = path[1]
    return [w for w in "".join(reversed(chars)).split("#") if w]


def signs_of(word: str) -> list[str]:
    return ["w" + word, *("s" + word[:n] for n in STEMS if len(word) > n)]


@dataclass
class Model:
    """``gate`` off searches every token that has more than one path, ``decoder`` off none; both are for comparisons."""

    characters: CharacterModel
    signs: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [0.0] * 3)
    gate: bool = True
    decoder: bool = True

    def __post_init__(self):
        self.kept: dict[str, tuple] = {}
        self.plain: set[str] = set()  # tokens that were found to have no sign
        self.heads = {s[1 : 1 + STEMS[0]] for s in self.signs}  # of every word that has a sign
        self.automaton = None

    def may_hide(self, token: str) -> bool:
        """Whether a reading of the token other than its spelling might hold a sign."""
        if not self.decoder or _LETTERS.match(token) and not _REPEATS.search(token):
            return False
        if not self.gate or "*" in token:
            return True
        core = token.strip(_EDGES)
        if core.isalpha() and not _REPEATS.search(core):  # every path is its own spelling
            return False
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for s in self.signs:
                self.automaton.add_word(skeleton(s[1:]), len(skeleton(s[1:])))
            self.automaton.make_automaton()
        if not len(self.automaton):
            return False
        if core.isalpha():  # one word, which starts where the letters do
            return any(end + 1 == n for end, n in self.automaton.iter(skeleton(core)))
        return next(self.automaton.iter(skeleton(token)), None) is not None

    def _odds(self, words: list[str]) -> tuple:
        get, out = self.signs.get, []
        for w in words:
            if w[: STEMS[0]] not in self.heads:
                continue
            odds = [x for s in signs_of(w) if (x := get(s))]
            if odds:
                out.append((w, max(odds)))
        return tuple(out)

    def signs_in(self, token: str) -> tuple:
        """Words with a sign that a token has or reads as."""
        got = self.kept.get(token)
        if got is None:
            if len(self.kept) + len(self.plain) > CACHE:
                self.kept.clear()
                self.plain.clear()
            words = [token] if token.isalpha() else _WORD.findall(token)
            got = self._odds(words + (decode(token, self.characters) if self.may_hide(token) else []))
            if got:
                self.kept[token] = got
            else:
                self.plain.add(token)
        return got

    def features(self, text: str | None) -> list[float]:
        """Constant, total of the different signs of a whole text, and its length."""
        text = (text or "").lower()
        found: dict[str, float] = {}
        tokens = text.split()
        for t in set(tokens).difference(self.plain):
            found.update(self.signs_in(t))
        for m in _SPACED.finditer(text):
            if self.may_hide(m.group()):
                found.update(self._odds(decode(m.group(), self.characters)))
        return [1.0, math.log1p(math.fsum(found.values())), math.log1p(len(tokens))]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.weights, self.features(text)))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _logistic(known: DataFrame) -> list[float]:
    """Ridge-penalized logistic regression of toxic on x (three numbers, the first 1) by Newton's method; each step is one row of sums."""
    w, penalty = np.zeros(3), np.array([1e-3, 0.05, 0.05])
    x = [F.get("x", F.lit(k)) for k in range(3)]
    upper = [(j, k) for j in range(3) for k in range(j, 3)]
    for _ in range(40):
        z = sum((x[k] * float(w[k]) for k in range(1, 3)), x[0] * float(w[0]))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
        rows = known.select("x", (p - F.col("toxic")).alias("off"), (p * (1 - p)).alias("v"))
        sums = list(rows.agg(*(F.sum(F.col("off") * x[k]).alias(f"g{k}") for k in range(3)), *(F.sum(F.col("v") * x[j] * x[k]).alias(f"h{j}{k}") for j, k in upper)).first())
        g, h = np.array(sums[:3]) + penalty * w, np.diag(penalty)
        for (j, k), value in zip(upper, sums[3:]):
            h[j, k] += value
            if j != k:
                h[k, j] += value
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return [round(float(v), 9) for v in w]  # sums differ in their last bits from run to run


def labelled_texts(docs: DataFrame, labels: DataFrame, allowed) -> DataFrame:
    """(text, toxic) of all label rows that ``allowed`` admits, each different text once; written."""
    own = labels.where(allowed & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    keyed = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    # one text of an id, then one row of a text, are told from ids and hashes: texts themselves are moved once, in the same way at every size
    least = keyed.select("doc_id", "h").join(own, "doc_id").groupBy("doc_id").agg(F.min("h").alias("h"), F.max("toxic").alias("toxic"))
    chosen = least.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("h"))
    rows = keyed.join(chosen.hint("merge"), ["doc_id", "h"]).withColumn("turn", turn).where("turn = 1")
    return materialize(rows.select("text", "toxic"), "learned-from", source=docs)


def fit(docs: DataFrame, labels: DataFrame, allowed=None) -> Model | None:
    """Learn from all labelled rows that ``allowed`` (a condition on doc_id) admits."""
    allowed = F.lit(True) if allowed is None else allowed
    rows = labelled_texts(docs.where(allowed), labels, allowed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bad, good, starts_bad, starts_good = every = [Counter() for _ in range(5)]

        def counted() -> pa.RecordBatch:
            grams: Counter = Counter()
            for w, n in words.items():  # each different word once
                w = f"##{w}#"
                for k in range(len(w) - 2):
                    grams[w[k : k + 3]] += n
            texts = [(mark + k, x, y) for mark, bads, goods in (("w", bad, good), ("s", starts_bad, starts_good)) for k in bads.keys() | goods.keys() for x, y in [(bads[k], goods[k])]]
            texts += [("c" + g, n, 0) for g, n in grams.items()]
            for c in every:
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*texts) if texts else [[]] * 3, (pa.string(), pa.int64(), pa.int64()))], names=["sign", "bad", "good"])

        for b in batches:
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = _WORD.findall(text.lower())
                words.update(own)
                own = set(own)
                (bad if toxic else good).update(own)
                starts = starts_bad if toxic else starts_good
                for n in STEMS:
                    starts.update({w[:n] for w in own if len(w) > n})
                if sum(map(len, every)) > COUNTED:
                    yield counted()
        yield counted()

    classes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not classes.get(0) or not classes.get(1):
        drop_shared(docs.sparkSession, rows)
        return None
    counts = rows.select("text", "toxic").mapInArrow(count, "sign string, bad long, good long").groupBy("sign").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = materialize(counts, "sign-counts")
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    odds = F.log(a / (classes[1] + 1)) - F.log(b / (classes[0] + 1)) - 2 * F.sqrt(1 / a + 1 / b)
    signs = counts.where("sign NOT LIKE 'c%'").where(F.col("bad") >= LEAST_TEXTS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), "sign").limit(SIGNS).collect()
    grams = counts.where("sign LIKE 'c%'").orderBy(F.desc("bad"), "sign").limit(TRIGRAMS).collect()
    model = Model(CharacterModel({r.sign[1:]: r.bad for r in grams if len(r.sign) == 4}), {r.sign: r.odds for r in signs})

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([model.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], names=["toxic", "x"])

    known = materialize(rows.select("text", F.col("toxic").cast("long")).mapInArrow(featurize, "toxic long, x array<double>"), "features")
    model.weights = _logistic(known)
    for table in (rows, counts, known):
        drop_shared(docs.sparkSession, table)
    if model.weights[1] < 0:  # signs speak for toxicity only
        model.weights = [math.log(classes[1] / classes[0]), 0.0, 0.0]
    return model


def score_texts(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) if model else 0.0 for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return score_texts(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
