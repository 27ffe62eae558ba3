"""Exact substring deduplication by recompression.

Words are symbols.  In rounds, runs of equal symbols get a name, then pairs: a
symbol's hash puts it left or right for the round, and a left symbol with a
right one after it merge.  A name is a hash of what it stands for, so it is
global, the same in every task, without rounds of Spark that number names;
equal substrings get the same symbols inside, and only near their ends does
the context decide.  Every
symbol carries the stretch of words that its existence depends on, so what a
window of words says by itself is known exactly.

Each window of ``WINDOW`` words picks, among the symbols that it determines at
the highest level at which there is one, the longest (then the least hash) as
its anchor: equal windows pick equal anchors.  Consecutive windows with one
anchor form a stretch, some fifteen windows wide, and only stretches are
shuffled: (anchor, hash of all words, smallest document).

* A stretch whose words also lie in a smaller document is repeated as a whole.
* An anchor seen with one context only has nothing more to compare.
* For the rest, which are few, the first document of each context lists its
  windows' own hashes, and the smallest document of each decides.

Copies thus end in one combined row per stretch however many there are, and a
passage in a third of all rows costs that much before the shuffle only.  What
decides has 128 bits: anchor and stretch, or a window's two hashes.

Stretches, marks and windows are written to the shared folder, so that each is
made once and what is shuffled for one step is dropped before the next.

Nulls and edge cases: a null text has no words; texts shorter than a window
keep all words; null ids count as larger than any other, and rows that share
an id (or have none) remove nothing from each other, but each loses what a
smaller id has, as spans belong to an id and a text; an empty table gives an
empty result; other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import documents, drop_shared, gathered, materialize, release

WINDOW = 50
#: Rounds of pair naming; runs are named before the rounds listed.
ROUNDS, RUNS_BEFORE = 5, (0,)
#: Levels (rounds done) at which a window looks for an anchor, in this order; words are the last resort.
LEVELS = (5, 3, 0)
#: Words handled at once.
BATCH_WORDS = 1 << 17
_NULL_ID = (1 << 63) - 1

_U = np.uint64
_A, _B = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Words whose hashes one worker keeps: the frequent ones, as others are quickly hashed again.
CACHE_WORDS = 50_000
_WORDS: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_WORDS) > CACHE_WORDS:
        _WORDS.clear()
    got = list(map(_WORDS.get, words))
    if None in got:
        for w in set(words):
            if w not in _WORDS:
                _WORDS[w] = xxhash.xxh64_intdigest(w, 11)
        got = list(map(_WORDS.__getitem__, words))
    return np.array(got, dtype=np.uint64)


class Symbols:
    """One level: names, word spans [first, end) and dependence [low, high)."""

    def __init__(self, name, first, end, low, high):
        self.name, self.first, self.end, self.low, self.high = name, first, end, low, high

    def runs(self) -> "Symbols":
        """Name maximal runs of equal symbols. A symbol depends on its neighbours, which end or might extend the run."""
        n = len(self.name)
        new = np.ones(n, dtype=bool)
        new[1:] = self.name[1:] != self.name[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        size = ends - starts
        name = np.where(size > 1, mix64(self.name[starts] * _A + size.astype(np.uint64) * _B), self.name[starts])
        low = np.where(starts > 0, self.low[starts - 1], -1)
        high = np.where(ends < n, self.high[np.minimum(ends, n - 1)], self.high[-1] + 1)
        return Symbols(name, self.first[starts], self.end[ends - 1], low, high)

    def pairs(self, round_: int) -> "Symbols":
        """Name pairs of a left and a right symbol. One that stays alone depends on the neighbour it might have joined."""
        n = len(self.name)
        left = (mix64(self.name + _U(round_ + 1) * _B) & _U(1)).astype(bool)
        joined = np.zeros(n, dtype=bool)
        joined[:-1] = left[:-1] & ~left[1:]
        second = np.zeros(n, dtype=bool)
        second[1:] = joined[:-1]
        keep = np.flatnonzero(~second)
        pair = joined[keep]
        after = np.minimum(keep + 1, n - 1)
        before = np.maximum(keep - 1, 0)
        name = np.where(pair, mix64(self.name[keep] * _A + mix64(self.name[after] + _U(round_))), self.name[keep])
        alone_left, alone_right = ~pair & left[keep], ~pair & ~left[keep]
        low = np.where(alone_right, np.where(keep > 0, self.low[before], -1), self.low[keep])
        high = np.where(pair | alone_left, np.where(keep + 1 < n, self.high[after], self.high[-1] + 1), self.high[keep])
        return Symbols(name, self.first[keep], np.where(pair, self.end[after], self.end[keep]), low, high)


def levels(hashes: np.ndarray) -> dict[int, Symbols]:
    """Symbols after each number of rounds in LEVELS."""
    at = np.arange(len(hashes), dtype=np.int64)
    s, out = Symbols(hashes, at, at + 1, at, at + 1), {}
    for r in range(ROUNDS + 1):
        if r in LEVELS:
            out[r] = s
        if r < ROUNDS:
            s = (s.runs() if r in RUNS_BEFORE else s).pairs(r)
    return out


def anchors(hashes: np.ndarray, valid: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each valid window start: the anchor's name and the word where it begins."""
    n = len(valid)
    name, place, open_ = np.zeros(n, dtype=np.uint64), np.full(n, -1, dtype=np.int64), np.flatnonzero(valid)
    for level, s in sorted(levels(hashes).items(), reverse=True):
        if not len(open_):
            break
        # dependence grows with position, so what a window determines is a range of symbols
        a = np.searchsorted(s.low, open_, "left")
        b = np.searchsorted(s.high, open_ + window, "right")
        some = a < b
        got, a, b = open_[some], a[some], b[some]
        if len(got):
            # the same range gives the same anchor: look once for each run of ranges
            new = np.ones(len(got), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            x, y = a[new], b[new]
            span = np.minimum(s.end - s.first, 255).astype(np.uint64)
            rank = (span << _U(56)) | (mix64(s.name + _U(level)) >> _U(8))
            best, most = x.copy(), rank[x]
            for k in range(1, int((y - x).max())):
                here = np.flatnonzero(x + k < y)
                better = here[rank[x[here] + k] > most[here]]
                best[better], most[better] = x[better] + k, rank[x[better] + k]
            chosen = best[np.cumsum(new) - 1]
            name[got] = mix64(s.name[chosen] + _U(level + 1) * _A)
            place[got] = s.first[chosen]
        open_ = open_[~some]
    return name, place


class Rolling:
    """Hashes of any stretch of words, as if all powers were reduced to its own start."""

    def __init__(self, hashes: np.ndarray):
        n, self.sums, self.back = len(hashes), [], []
        with np.errstate(over="ignore"):
            for base in (0x5851F42D4C957F2D, 0xDA942042E4DD58B5):
                up, down = (np.cumprod(np.concatenate([[_U(1)], np.full(n, b, dtype=np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
                salted = mix64(hashes + _U(base))
                self.sums.append(np.concatenate([[_U(0)], np.cumsum(salted * up[:n], dtype=np.uint64)]))
                self.back.append(down)

    def of(self, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [mix64((s[end] - s[first]) * b[first] + (end - first).astype(np.uint64)) for s, b in zip(self.sums, self.back)]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _stretches(docs: DataFrame, window: int) -> DataFrame:
    """(doc, row, first, last, anchor, h1): windows first..last of a row share an anchor; the hash is of all their words."""

    def handle(held: list[tuple[int, int, list[bytes]]]) -> pa.RecordBatch:
        # documents lie one after the other, a symbol of its own between any two
        starts, words, n = [], [], 0
        for _, _, own in held:
            starts.append(n)
            words += own
            n += len(own) + 1
        hashes, valid, at = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool), 0
        flat = word_hashes(words)
        for k, (start, (_, _, own)) in enumerate(zip(starts, held)):
            hashes[start : start + len(own)] = flat[at : at + len(own)]
            at += len(own)
            hashes[start + len(own)] = mix64(np.array([k + 1], dtype=np.uint64) * _B)[0]
            valid[start : start + len(own) - window + 1] = True
        with np.errstate(over="ignore"):
            name, place = anchors(hashes, valid, window)
            roll = Rolling(hashes)
        ok = np.flatnonzero(valid)
        new = np.ones(len(ok), dtype=bool)
        new[1:] = (place[ok][1:] != place[ok][:-1]) | (name[ok][1:] != name[ok][:-1]) | (ok[1:] != ok[:-1] + 1)
        first = ok[new]
        last = np.append(ok[np.flatnonzero(new)[1:] - 1], ok[-1])
        doc = np.searchsorted(np.array(starts), first, "right") - 1
        with np.errstate(over="ignore"):
            h1, h2 = roll.of(first, last + window)
            h1 = mix64(h1 + h2 * _A + (place[first] - first).astype(np.uint64))
        base = np.array(starts)[doc]
        ids, rows = (np.array([x[k] for x in held], dtype=np.int64)[doc] for k in (0, 1))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(rows), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (name[first], h1))],
            names=["doc", "row", "first", "last", "anchor", "h1"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                own = _words(text.as_py())
                if len(own) >= window:
                    held.append((doc, row, own))
                    size += len(own)
                    if size > BATCH_WORDS:
                        yield handle(held)
                        held, size = [], 0
        if held:
            yield handle(held)

    return docs.select("doc", "row", "text").mapInArrow(run, "doc long, row long, first int, last int, anchor long, h1 long")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(doc, row, first, last) of window starts that repeat as whole stretches, and of stretches whose windows must be compared one by one.

    ``docs`` has doc (long, not null), row (long: tells rows of one doc apart) and text.
    """
    spark = docs.sparkSession
    found = materialize(_stretches(docs, window), "stretches")
    contexts = found.groupBy("anchor", "h1").agg(F.min("doc").alias("least"), (F.max("doc") > F.min("doc")).alias("shared"))
    several = contexts.groupBy("anchor").agg((F.count("*") > 1).alias("several"), F.max("shared").alias("any_shared"))
    # what is neither shared nor has a second context goes nowhere
    useful = contexts.join(several.where("several OR any_shared"), "anchor").where("several OR shared").select("anchor", "h1", "least", "several")
    marked = found.join(useful, ["anchor", "h1"]).where("least < doc OR several").select("doc", "row", "first", "last", (F.col("least") < F.col("doc")).alias("whole"))
    marked = materialize(marked, "marked")
    drop_shared(spark, found)
    release(spark)
    return marked.where("whole").drop("whole"), marked.where("NOT whole").drop("whole")


def _spans(df: DataFrame) -> DataFrame:
    """For each doc and row its different spans."""
    return df.groupBy("doc", "row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _window_hashes(spanned: DataFrame, window: int) -> DataFrame:
    """(doc, row, start, h1, h2) of each window in a row's spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, row, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                with np.errstate(over="ignore"):
                    roll = Rolling(word_hashes(_words(text.as_py())))
                    at = np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans.as_py()])
                    h1, h2 = roll.of(at, at + window)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), doc)), pa.array(np.full(len(at), row)), pa.array(at.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc", "row", "start", "h1", "h2"])

    return spanned.select("doc", "row", "text", "spans").mapInArrow(run, "doc long, row long, start int, h1 long, h2 long")


def kept_words(words: list[bytes], spans: list[dict], window: int) -> list[bytes]:
    """Words that no window start in ``spans`` covers."""
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for s in spans:
        edges[s["first"]] += 1
        edges[s["last"] + window] -= 1
    gone = np.cumsum(edges[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def removals(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``__spans``: window starts (first, last) whose words go (null: none). Needs a text column ``text``."""
    text = F.col("text").cast("string")
    keyed = docs.withColumns({"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)), "__row": F.xxhash64(text)})
    texts = keyed.select(F.col("__doc").alias("doc"), F.col("__row").alias("row"), text.alias("text"))
    whole, single = repeated_spans(texts, window)
    windows = materialize(_window_hashes(texts.join(_spans(single), ["doc", "row"]), window), "windows")
    release(docs.sparkSession)
    least = windows.groupBy("h1", "h2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    late = windows.join(least, ["h1", "h2"]).where("least < doc").select("doc", "row", F.col("start").alias("first"), F.col("start").alias("last"))
    spans = materialize(_spans(whole.union(late)).select(F.col("doc").alias("__doc"), F.col("row").alias("__row"), F.col("spans").alias("__spans")), "spans")
    drop_shared(docs.sparkSession, windows)
    release(docs.sparkSession)
    return gathered(keyed.join(spans, ["__doc", "__row"], "left").select(*docs.columns, "__spans"), docs)


def removed_report(spanned: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, spans in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                words = _words(text.as_py())
                kept = kept_words(words, spans.as_py(), window) if spans.as_py() else words
                out.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return spanned.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "__spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (with doc_id, text and n_chars) without the words that repeat: a changed text is its kept words, joined by one space; one that loses all its words goes.

    Nulls, ties and clashing names as above: null texts and texts that lose nothing stay as they are, as do all other columns; an empty table stays empty.
    """
    names = docs.columns
    # other columns, whatever their names, are inside ``whole``
    spanned = removals(docs.select("doc_id", "text", F.struct("*").alias("whole")), window)
    spanned = spanned.select(*(F.col("whole").getField(c).alias(f"c{k}") for k, c in enumerate(names)), F.col("__spans").alias("spans"))
    at_text, at_n, at_spans = names.index("text"), names.index("n_chars"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = b.column(at_text).to_pylist(), b.column(at_spans).to_pylist()
            n_chars, stays = b.column(at_n).to_pylist(), [True] * b.num_rows
            for k, own in enumerate(spans):
                if own:
                    texts[k] = b" ".join(kept_words(_words(texts[k]), own, window)).decode("utf-8", "surrogatepass")
                    n_chars[k], stays[k] = len(texts[k]), bool(texts[k])
            columns = list(b.columns[:at_spans])
            columns[at_text], columns[at_n] = pa.array(texts, pa.string()), pa.array(n_chars, pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays))

    return spanned.mapInArrow(run, docs.schema)


def op3_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_report(removals(documents(spark, sf_dir).select("doc_id", "text")))
