"""Tables of buckets: what a batch does not touch keeps its files; relations wait for their ends."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import store


def entities(spark, *ids, name="n"):
    return spark.createDataFrame([(i, f"{name} {i}", "tool", None, 1, [], None) for i in ids], schema.ENTITY)


def relations(spark, *rows):
    return spark.createDataFrame([(*r, "d", 1, 1) for r in rows], schema.RELATED)


def files(s, table):
    count, folders = s._folders(table, s.version(table))
    return {b: sorted(f.rsplit("/", 1)[1] for f in s._read(table, [x]).inputFiles()) for b, x in folders.items()}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path), buckets=16)
    s.upsert("entity", entities(spark, *(f"e{k}" for k in range(300))))
    before = files(s, "entity")
    assert len(before) == 16
    s.upsert("entity", entities(spark, "e7", "e8", name="new"))
    after = files(s, "entity")
    changed = {b for b in before if before[b] != after[b]}
    assert 1 <= len(changed) <= 2 and set(after) == set(before)
    names = {r.id: r.name for r in s.read("entity").collect()}
    assert len(names) == 300 and names["e7"] == "new e7" and names["e9"] == "n e9"
    assert {r.id for r in s.read_near("entity", entities(spark, "e7")).collect()} > {"e7"}
    assert s.read_near("entity", entities(spark, "e7")).count() < 60
    s.delete("entity", entities(spark, "e7", "nobody"))
    assert s.read("entity").count() == 299 and sum(files(s, "entity")[b] != after[b] for b in after) == 1


def test_replays_and_many_small_batches(spark, tmp_path):
    """As one table written whole, whatever the batches; folders that no version names are gone."""
    s, draw, want = store.TableStore(spark, str(tmp_path), buckets=4), random.Random(2), {}
    for turn in range(5):
        ids = draw.sample(range(40), 6)
        batch = entities(spark, *(f"e{k}" for k in ids), name=f"t{turn}")
        for _ in range(2):
            s.upsert("entity", batch)
        want |= {f"e{k}": f"t{turn} e{k}" for k in ids}
    assert {r.id: r.name for r in s.read("entity").collect()} == want
    named = {f for n, v in s._pointers("entity").items() for f in s._folders("entity", (n, v))[1].values()}
    there = {f"{p.parent.name}/{p.name}" for p in (tmp_path / "entity").glob("v-*/bucket=*")}
    assert named == there and len(s._pointers("entity")) == 2


def test_the_number_of_buckets_stays_with_the_table(spark, tmp_path):
    store.TableStore(spark, str(tmp_path), buckets=4).upsert("entity", entities(spark, *"abcdef"))
    s = store.TableStore(spark, str(tmp_path), buckets=9)
    s.upsert("entity", entities(spark, "a", "z", name="new"))
    assert sorted(r.name for r in s.read("entity").collect()) == ["n b", "n c", "n d", "n e", "n f", "new a", "new z"]


def test_two_writers_of_different_buckets_meet(spark, tmp_path, monkeypatch):
    a, b = (store.TableStore(spark, str(tmp_path), buckets=8) for _ in range(2))
    a.upsert("entity", entities(spark, "x"))
    plain = store.upserted

    def late(old, new, key):  # the other writer ends while this one is at work
        monkeypatch.setattr(store, "upserted", plain)
        b.upsert("entity", entities(spark, "y"))
        return plain(old, new, key)

    monkeypatch.setattr(store, "upserted", late)
    with pytest.raises(store.ConcurrentWrite):
        a.upsert("entity", entities(spark, "z"))
    assert sorted(r.id for r in a.read("entity").collect()) == ["x", "y"]


def test_keys_with_nulls(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path), buckets=4)
    rows = lambda text: spark.createDataFrame([(1, None, text, 1, 1), (1, "b", text, 1, 1), (2, None, text, 1, 1)], schema.CHUNK)
    s.upsert("chunk", rows("old"))
    s.upsert("chunk", rows("new").where("book_id IS NULL"))
    assert sorted((r.chunk_index, r.book_id or "", r.text) for r in s.read("chunk").collect()) == [(1, "", "new"), (1, "b", "old"), (2, "", "new")]


def test_order_of_batches_does_not_change_the_graph(spark, tmp_path):
    steps = {
        "a": lambda s: s.upsert("entity", entities(spark, "a")), "bc": lambda s: s.upsert("entity", entities(spark, "b", "c")),
        "r": lambda s: s.upsert_relations(relations(spark, ("a", "b", "requires"), ("c", "a", "extends"), ("b", "never", "requires"))),
    }
    for k, order in enumerate(itertools.permutations(steps)):
        s = store.TableStore(spark, str(tmp_path / str(k)), buckets=4)
        for step in order:
            steps[step](s)
        assert sorted((r.src, r.dst, r.type) for r in s.read("related").collect()) == [("a", "b", "requires"), ("c", "a", "extends")], order
        assert [(r.src, r.dst, r.missing_endpoint) for r in s.read("orphan").collect()] == [("b", "never", "target")], order


def test_what_waits_is_replaced_by_what_comes_later(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path), buckets=4)
    s.upsert_relations(relations(spark, ("a", "b", "requires")))
    assert s.read("orphan").first().missing_endpoint == "both"
    s.upsert("entity", entities(spark, "a"))
    assert s.read("orphan").first().missing_endpoint == "target"
    s.upsert_relations(relations(spark, ("a", "b", "requires")).withColumn("description", F.lit("newer")))
    s.upsert("entity", entities(spark, "b"))
    assert s.read("related").first().description == "newer" and s.read("orphan").isEmpty()


def test_all_missing_ends_are_told(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path), buckets=4)
    rows = relations(spark, *((f"x{k:03}", "y", "requires") for k in range(150)))
    with pytest.raises(store.MissingEnds, match="151 missing ends: x000, x001") as e:
        s.upsert_relations(rows, "fail_loud")
    assert [r.id for r in e.value.ids.collect()] == [*(f"x{k:03}" for k in range(150)), "y"]
    assert s.read("related").isEmpty() and s.read("orphan").isEmpty()


def test_merged_mentions_are_hashed_and_not_sorted(spark):
    from graphloom.operators import store as St

    schema = "chunk_index long, book_id string, entity_id string, source_page int"
    old = spark.createDataFrame([(1, "b", "x", 5), (1, "b", "x", 4), (1, None, "x", None), (2, "b", "y", None)], schema)
    new = spark.createDataFrame([(1, "b", "x", 1), (1, None, "x", 7), (1, None, "x", 6), (3, "b", "z", None)], schema)
    merged = St.merged_mentions(old, new)
    assert sorted(map(tuple, merged.collect()), key=repr) == sorted([(1, "b", "x", 4), (1, None, "x", 6), (2, "b", "y", None), (3, "b", "z", None)], key=repr)
    assert "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()
