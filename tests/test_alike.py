"""What is told of pairs from their groups against the pairs themselves."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import alike, audit, community, store, traverse
from graphloom.sources import tables as T


def made(spark, seed=3, n=40):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(25)}", rng.choice("ghij"), rng.choice("xy")) for _ in range(n)] + [("alone", "k", "x")]


def brute(rows):
    return [(a, b) for a in rows for b in rows if a[1] == b[1] and a[0] != b[0]]


@pytest.mark.parametrize("seed", range(2))
def test_pairs_are_told_from_members(spark, seed):
    rows = made(spark, seed)
    members, every = spark.createDataFrame(rows, "node string, group string, label string"), brute(rows)
    ends = sorted((a[0], b[0]) for a, b in every)
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(alike.pairs(members).select("src", "dst")) == ends
    near = spark.createDataFrame([("n1",), ("n2",)], "node string")
    assert got(alike.pairs(members, near).select("src", "dst")) == [x for x in ends if x[0] in ("n1", "n2")]
    assert got(alike.pair_counts(members)) == sorted((*k, n) for k, n in Counter((a[2], b[2]) for a, b in every).items())
    assert {r.node for r in alike.partnered(members).collect()} == {a for a, _ in ends}
    assert got(alike.simple_pairs(members)) == sorted({x for x in ends if x[0] < x[1]})
    assert got(alike.repeated(members)) == sorted(x for x, n in Counter(ends).items() if n > 1)
    for limit in (1, 7, 2000):
        some = members.where("label = 'x'")
        wanted = sorted(((a[0], b[0]) for a, b in every if b[2] == "x"), key=lambda x: (x[0] + "|", x[1]))[:limit]
        assert [tuple(r) for r in sorted(alike.least_pairs(members, some, limit).collect(), key=lambda x: (x[0] + "|", x[1]))] == wanted
    links = spark.createDataFrame(ends, "a string, b string")
    assert got(community.component_labels(alike.stars(members))) == got(community.component_labels(links))


def test_graph_of_pairs_is_simple(spark):
    rows = made(spark)
    members = spark.createDataFrame(rows, "node string, group string, label string")
    e = spark.createDataFrame([(f"n{k}", "tool") for k in range(20)], "id string, type string")
    plain = spark.createDataFrame([("n1", "n2"), ("n2", "n1"), ("n3", "n3"), ("n4", "zz"), *((a[0], b[0]) for a, b in brute(rows)[:9])], "src string, dst string")
    whole = community.simple_graph(e, plain.union(alike.pairs(members).select("src", "dst")))
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(community.simple_graph(e, plain, members)) == got(whole)
    own = spark.createDataFrame([(lv, str((k + lv) % 3), f"n{k}") for k in range(20) for lv in (1, 2)], "level int, id string, entity string")
    none = whole.limit(0)
    pairs = community.simple_graph(e, none.select(F.col("a").alias("src"), F.col("b").alias("dst")), members)
    assert got(community.induced_edges(own, none, members)) == got(community.induced_edges(own, pairs))


def test_no_query_makes_relations_that_it_only_counts(spark, monkeypatch):
    """Running all relations of the groups is an error here; before, each of these ran them."""
    from graphloom.plans import queries as Q

    whole = lambda members, near=None: alike.pairs(members, near) if near is not None else alike.pairs(members).where(F.raise_error(F.lit("all pairs")).isNull())
    monkeypatch.setattr(T, "alike_pairs", whole)
    names = "a1_count_edges a4_inventory_edges a6_bounded_sample a7_collect_distinct j1_pattern j3_orphan_split j10_shortest_path j11_isolated j14_induced_edges j8_traverse_d2 j8_traverse_entities q5_search_rag t9_isolated_sample g1_simple_graph g2_components w3_rel_upsert x2_missing_ids p8_null_safe"
    for name in names.split() + [f"audit_{r.lower()}" for r in audit.RULES] + ["audit_summary"]:
        Q.QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_orphans_of_pairs(spark):
    rows = made(spark)
    members = spark.createDataFrame(rows, "node string, group string, label string")
    ids = spark.createDataFrame([(f"n{k}",) for k in range(0, 25, 2)], "id string")
    plain = spark.createDataFrame([("n1", "n2", "t"), ("n2", "n4", "t")], "src string, dst string, type string")
    valid, orphans = store.split_orphans(plain.union(alike.pairs(members).select("src", "dst", F.lit("t"))), ids)
    wanted = Counter(r.missing_endpoint for r in orphans.collect()) + Counter(none=valid.count())
    assert {r.missing_endpoint: r.n for r in store.orphan_counts(plain, members, ids).collect()} == dict(wanted)


def test_trails_ask_for_the_edges_of_their_nodes(spark):
    d = "/root/testdata/sf0.001"
    key = lambda df: sorted(map(str, df.select("length", "nodes", "kinds").collect()))
    assert key(traverse.trails(T.relations_from(spark, d), "customer-1-framework", 2)) == key(traverse.trails(T.relations(spark, d), "customer-1-framework", 2))
