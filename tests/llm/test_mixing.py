"""The mix against targets found by plain iteration, and the guarantees of dependent rounding."""

import re
from collections import defaultdict

import pytest

from graphloom.llm import mixing

from .helpers import edge_documents, save_documents


def slow_targets(sizes):
    """Reshare the excess until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes.values())
    capped: dict = {}
    while True:
        free = [s for s in names if s not in capped]
        rest, units = total - sum(capped.values()), sum(weight[s] for s in free)
        share = {s: rest * weight[s] / units for s in free} if units else {}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def check(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = mixing.op2_mixing(spark, folder).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(((r.doc_id, r["size"], r.source) for r in rows), key=str) == sorted(((d.doc_id, size(d.text), d.source) for d in docs), key=str)
    own, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        own[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    targets = slow_targets(own)
    for r in rows:
        assert r.source_size == own[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-9)
    for s in own:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1e-6
    return rows


def test_all_and_again(spark, sf_dir):
    rows = check(spark, sf_dir)
    assert sorted(rows) == sorted(mixing.op2_mixing(spark, sf_dir).collect())


def test_edges(spark, tmp_path):
    check(spark, save_documents(edge_documents(spark), tmp_path))


def test_empty(spark, tmp_path):
    assert mixing.op2_mixing(spark, save_documents(edge_documents(spark).limit(0), tmp_path)).count() == 0


def test_many_levels_and_a_hot_source(spark, tmp_path):
    rows = [(k, "w " * (k % 37 + 1), "hot" if k % 3 else f"s{k % 9}") for k in range(40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = check(spark, save_documents(df, tmp_path))
    taken = sum(r.taken for r in got if r.source == "hot")
    target = next(r.target for r in got if r.source == "hot")
    assert abs(taken - target) <= 20


def test_documents_repeat(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, "c", "y"), (3, None, None)], "doc_id long, text string, source string")
    got = mixing.mix_documents(df)
    assert got.columns == df.columns
    counts = mixing.mix(df).groupBy("doc_id").sum("copies").collect()
    assert {r.doc_id: r[1] for r in counts if r[1]} == {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}


def test_repeated_rows_and_clashing_names(spark, tmp_path):
    """Thousands of equal rows, null ids and columns with the operator's own names."""
    rows = [(None, "a b c", "hot")] * 3000 + [(5, "d e", "hot")] * 500 + [(k, "w " * (k % 9), f"s{k % 4}") for k in range(600)]
    names = ["copies", "h", "size", "n", "row", "target", "part_id", "__copies"]
    df = spark.createDataFrame([(*r, *range(8)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names)).repartition(5)
    folder = save_documents(df, tmp_path)
    taken = defaultdict(int)
    for r in check(spark, folder):
        taken[r.doc_id, r.source] += r.copies
    got = mixing.mix_documents(spark.read.parquet(f"{folder}/documents.parquet"))
    assert got.columns == df.columns
    counts = {(r.doc_id, r.source): r["count"] for r in got.groupBy("doc_id", "source").count().collect()}
    assert {k: n for k, n in taken.items() if n} == counts
