"""Searches that read the index against searches that read the texts."""

import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from graphloom.operators import search
from graphloom.operators.postings import SearchIndex, search_chunks

SCHEMA = "chunk_index long, book_id string, text string"
WORDS = ["agent", "graph", "plan", "tool", "node", "edge", "risk", "the", "of", "a"]


def rows(draw, n, book="b"):
    return [(k, book if k % 7 else None, " ".join(draw.choice(WORDS) for _ in range(int(draw.expovariate(0.02))))) for k in range(n)]


def same(index, chunks, query, limit):
    got = [tuple(r) for r in index.search(query, limit).collect()]
    want = search.bm25(chunks, ["chunk_index", "book_id"], F.col("text"), query).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "chunk_index", "book_id").limit(limit)
    assert got == [tuple(r) for r in want.collect()]
    return got


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    draw = random.Random(4)
    data = rows(draw, 600)
    data += [(1000, "b", None), (1001, "b", ""), (1002, "b", "rare Ärger"), (1003, "b", "agent " * 300)]
    chunks = spark.createDataFrame(data, SCHEMA)
    index = SearchIndex(spark, str(tmp_path_factory.mktemp("terms")), buckets=16)
    index.build(chunks, F.col("text"))
    return index, chunks


@pytest.mark.parametrize("query", ["agent", "the risk of a tool", "rare", "ÄRGER agent", "missing", "missing node", "", "!?"])
def test_same_answers(built, query):
    same(*built, query, 10)


def test_limits(built):
    assert len(same(*built, "agent tool", 1)) == 1 and len(same(*built, "agent", 5000)) > 300
    assert built[0].search("agent", 0).collect() == []


def test_only_the_terms_folders_are_read(built):
    index, _ = built
    terms, buckets = index._terms("agent risk")
    assert 0 < len(buckets) <= 2
    plan = index.scored(terms, buckets, {t: 1.0 for t in terms}, 10.0, [1, 2])._jdf.queryExecution().toString()
    line = next(x for x in plan.split("\n") if "PartitionFilters" in x and "bucket" in x)
    assert "PartitionFilters: [bucket" in line.replace("isnotnull(bucket#", "bucket#") or "bucket#" in line.split("PartitionFilters")[1].split("]")[0]
    assert "PushedFilters" in plan and "In(term, [agent,risk])" in plan
    read = index.postings().where(F.col("bucket").isin(buckets)).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in index.scored(terms, buckets, {t: 1.0 for t in terms}, 10.0).inputFiles()} >= {str(b) for b in buckets} and read


def test_blocks_with_low_bounds_are_skipped(spark, tmp_path, monkeypatch):
    """Short texts full of the term beat every bound of long texts with one of it."""
    data = [(k, "b", "agent agent agent") for k in range(40)] + [(100 + k, "b", "agent " + "word " * 2000) for k in range(200)]
    chunks = spark.createDataFrame(data, SCHEMA)
    index = SearchIndex(spark, str(tmp_path / "t"), buckets=4)
    index.build(chunks, F.col("text"))
    asked, plain = [], index.scored
    monkeypatch.setattr(index, "scored", lambda *a: asked.append(a[4] if len(a) > 4 else None) or plain(*a))
    same(index, chunks, "agent", 5)
    every = {r.block for r in index.blocks().select("block").distinct().collect()}
    assert asked and all(x is not None and set(x) < every for x in asked)


def test_updates_and_deletes(spark, tmp_path):
    draw = random.Random(5)
    first = rows(draw, 200)
    index = SearchIndex(spark, str(tmp_path / "t"), buckets=8)
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    now = {r[:2]: r for r in first}
    index.build(make(first), F.col("text"), "v1")
    for turn in range(3):
        changed = [(k, b, " ".join(draw.choice(WORDS) for _ in range(draw.randrange(1, 40)))) for k, b in draw.sample(sorted(now, key=repr), 30)]
        gone = draw.sample([k for k in now if k not in {c[:2] for c in changed}], 15)
        added = [(1000 + 10 * turn + k, None if k % 2 else "new", "agent risk new") for k in range(6)]
        old = [now[c[:2]] for c in changed] + [now.pop(k) for k in gone]
        index.update(make(changed + added), make(old), F.col("text"), f"v{turn + 2}")
        now |= {r[:2]: r for r in changed + added}
        assert index.note() == f"v{turn + 2}" and index.totals()[0] == len(now)
        for query in ("agent", "new risk", "the of"):
            same(index, make(list(now.values())), query, 12)
    before = same(index, make(list(now.values())), "agent risk", 20)
    assert len(index.segments()) == 4
    index.build(make(list(now.values())), F.col("text"))
    assert len(index.segments()) == 1 and same(index, make(list(now.values())), "agent risk", 20) == before


def test_an_unfinished_segment_does_not_count_and_writers_are_told(spark, tmp_path, monkeypatch):
    chunks = spark.createDataFrame([(1, "b", "agent")], SCHEMA)
    index = SearchIndex(spark, str(tmp_path / "t"), buckets=4)
    assert index.search("agent").collect() == [] and index.note() is None
    index.build(chunks, F.col("text"), "one")
    monkeypatch.setattr(index, "_mark", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        index.update(spark.createDataFrame([(2, "b", "agent agent")], SCHEMA), chunks, F.col("text"), "two")
    monkeypatch.undo()
    assert index.note() == "one" and [r.chunk_index for r in index.search("agent").collect()] == [1]
    taken, fs = index._file("_writing", f"{3:09d}")
    fs.create(taken, False).close()
    monkeypatch.setattr(index, "_file", lambda *p, plain=index._file: plain("_writing", f"{3:09d}") if p[0] == "_writing" and len(p) == 2 else plain(*p))
    with pytest.raises(Py4JJavaError):
        index.build(chunks, F.col("text"))


def test_texts_of_what_is_found(built):
    index, chunks = built
    got = [(r.chunk_index, r.book_id, r.score) for r in search_chunks(index, chunks, "rare agent", 4).collect()]
    assert got == [tuple(r) for r in index.search("rare agent", 4).collect()] and got[0][0] == 1002
