"""Periodic runs of words, found with a suffix automaton.

A run is a longest stretch of words with smallest period q and a length of at
least ``LEAST`` and 2q.  The automaton of a text has a state for each class of
substrings that end at the same positions.  From the longest states on, each
state's ordered set of end positions is merged into its suffix link's, the
smaller into the larger.  Positions x < y that become neighbours there share
exactly the state's length of words before them: where y - x is not more than
that length they seed a square.  The shared words reach as far to the left as
the run does; of a run's seeds, the one after which the words differ marks its
right end, so no run is extended word by word and none is found twice.

Only stretches whose words all belong to a repeated sequence of half of
``LEAST`` words enter an automaton.  That leaves out no run: of a run of
length m and period q, the m - q words from its start equal those from q on,
m - q is at least half of ``LEAST`` and q, so these two cover the run; and a
run lies in one stretch, beyond whose ends its period is broken.  States
shorter than that seed no run that is long enough and are not merged.

Nulls and edge cases: a null, empty or blank text has no words and no runs; a
text is looked at whole, in memory that grows with its longest repeated
stretch (some 400 bytes a word); rows are taken one by one, so repeated rows
have equal results and null ids stay; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import WORD_PATTERN, documents, gathered

#: Words that a run has at least.
LEAST = 12
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _automaton(w: list[int]) -> tuple[array, array, array]:
    """Length, suffix link and own end position (-1: none) of each state of the suffix automaton of ``w``."""
    length, link, end, step = array("q", [0]), array("q", [-1]), array("q", [-1]), [{}]
    last = 0
    for i, c in enumerate(w):
        new = len(step)
        length.append(length[last] + 1)
        link.append(0)
        end.append(i)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                step.append(dict(step[q]))
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return length, link, end


def runs_of(w: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``w``, in no order."""
    length, link, end = _automaton(w)
    half, n, found = (least + 1) // 2, len(w), []
    ends: dict[int, list[int]] = {v: [x] for v, x in enumerate(end) if x >= 0}

    def seed(x: int, y: int, shared: int) -> None:
        if y - x <= shared and shared + y - x >= least and (y + 1 == n or w[x + 1] != w[y + 1]):
            found.append((x - shared + 1, shared + y - x, y - x))

    for v in np.argsort(-np.frombuffer(length, dtype=np.int64), kind="stable").tolist():
        own, parent = ends.pop(v, None), link[v]
        if own is None or parent < 0 or (shared := length[parent]) < half:
            continue
        big = ends.get(parent)
        if big is None:
            ends[parent] = own
            continue
        if len(big) < len(own):
            big, own = own, big
        at = [bisect_left(big, x) for x in own]
        for k, (x, i) in enumerate(zip(own, at)):
            # neighbours from both sets; those of one set were neighbours before, or stay apart
            if i and (not k or at[k - 1] != i):
                seed(big[i - 1], x, shared)
            if i < len(big) and (k + 1 == len(at) or at[k + 1] != i):
                seed(x, big[i], shared)
        if len(own) < 8:
            for x, i in zip(reversed(own), reversed(at)):
                big.insert(i, x)
        else:  # two ordered parts: one merge
            big += own
            big.sort()
        ends[parent] = big
    return found


def stretches(ids: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """(first, end) of the longest stretches of words that belong to a sequence of ``gram`` words which occurs again."""
    n = len(ids) - gram + 1
    if n < 2:
        return []
    h = np.zeros(n, dtype=np.uint64)
    for k in range(gram):  # sequences of equal value that differ only let more words in
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return []
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + gram, -1)
    inside = np.concatenate([[False], np.cumsum(covered[:-1]) > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def text_runs(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start, then period."""
    if len(words) < least:
        return []
    known: dict = {}
    ids = [known.setdefault(x, len(known)) for x in words]
    found = []
    for first, end in stretches(np.array(ids, dtype=np.int64), (least + 1) // 2):
        if end - first >= least:
            found += [(first + s, m, q) for s, m, q in runs_of(ids[first:end], least)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that follow the first period of a run that has them."""
    out, at = [], 0
    for first, end in sorted((s + q, s + m) for s, m, q in found):
        if first > at:
            out += words[at:first]
        at = max(at, end)
    return out + words[at:]


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every row: doc_id, n_words, its runs (by start, then period), and its words without repeats, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                counts, ends, flat, kept = [], [0], [], []
                for text in b.column(1).to_pylist():
                    words = (text or "").encode().split()
                    found = text_runs(words, least)
                    flat += found
                    ends.append(len(flat))
                    counts.append(len(words))
                    kept.append(b" ".join(collapse(words, found)).decode())
                columns = list(zip(*flat)) if flat else [[]] * 3
                runs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with its later words in periods, for one document of ten by the checksum of its id (null ids: none)."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))

    def bind(ws: Column) -> Column:
        n, g = F.size(ws).cast("long"), F.floor(h / 10)
        a = F.pmod(g, n)
        return F.struct(ws.alias("ws"), n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).alias("p"))

    def repeat(x: Column) -> Column:
        later = lambda i: x["a"] + F.pmod(i - x["a"], x["p"])
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.get(x["ws"], F.when(i < x["a"], i).otherwise(later(i)).cast("int"))))

    # arrays of one: what a lambda is given is made once
    bound = F.transform(F.filter(F.array(words), lambda ws: F.size(ws) > 0), bind)
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), F.coalesce(F.get(F.transform(bound, repeat), F.lit(0)), text)).otherwise(text)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find_runs(gathered(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")), docs))
    # the greatest length, then the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).alias("lines"), "collapsed").select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"), F.call_function("div", 1000 * F.col("best.length"), -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
