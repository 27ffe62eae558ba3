"""Traversal, paths, lookup, audit, store, migration and communities on small graphs."""

import random
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from graphloom import schema
from graphloom.operators import audit, community, evaluate, extract, lookup, migrate, search, store, textquery, traverse
from graphloom.sources import books, tables
from graphloom.streaming import query_log


def entities(spark, rows):
    """(id, name, type, aliases)"""
    return spark.createDataFrame([(i, n, t, f"about {n}", None, a, None) for i, n, t, a in rows], schema.ENTITY)


def relations(spark, rows):
    return spark.createDataFrame([(a, b, t, "d", 1, 1) for a, b, t in rows], schema.RELATED)


def mentions(spark, rows):
    return spark.createDataFrame([(c, b, e, None) for c, b, e in rows], schema.MENTIONS)


@pytest.fixture(scope="module")
def small(spark):
    e = entities(spark, [("a", "Alpha", "agent", []), ("b", "Beta", "tool", ["MCP"]), ("c", "alpha", "tool", []), ("d", "Alphabet soup", "risk", [])])
    r = relations(spark, [("a", "b", "requires"), ("b", "c", "enables"), ("c", "a", "requires"), ("a", "a", "extends"), ("a", "b", "extends")])
    m = mentions(spark, [(12, "book-1", "b"), (3, "book-2", "b"), (7, None, "a"), (1, "z", "d")])
    return e, r, m


def test_tiers(small):
    e, _, m = small
    find = lambda *a, **k: [(r.id, r.tier, r.source) for r in lookup.find_entity(e, m, *a, **k).collect()]
    assert find("Alpha") == [("a", 1, "chunk_index=7")]
    assert find("ALPHA") == [("a", 2, "chunk_index=7"), ("c", 2, None)] or sorted(find("ALPHA")) == [("a", 2, "chunk_index=7"), ("c", 2, None)]
    assert find("bet") == [("d", 3, "book_id=z,chunk_index=1")]
    assert find("mcp") == []
    assert find("mcp", search=search.search_entities) == [("b", 4, "book_id=book-1,chunk_index=12")]
    assert find("mcp", search=lambda *_: 1 / 0) == []
    assert find("ALPHA", "tool") == [("c", 2, None)]


def test_limit_comes_after_provenance(spark):
    e = entities(spark, [(f"x{k}", f"name {k}", "tool", []) for k in range(5)])
    m = mentions(spark, [(k, "b", "x0") for k in range(150)])
    assert len(lookup.find_entity(e, m, "name", limit=4).collect()) == 4


def test_batches_are_bounded(small):
    e, _, m = small
    assert {r.id for r in lookup.find_batch(e, m, ["b", "b", "nope"]).collect()} == {"b"}
    with pytest.raises(schema.BatchSizeExceeded):
        lookup.find_batch(e, m, [str(k) for k in range(201)])


def test_pages_cover_everything_once(small):
    e, _, _ = small
    seen, after = [], None
    while rows := lookup.page(e, after, 3).collect():
        seen += [r.id for r in rows]
        after = lookup.next_cursor(rows, after)
    assert seen == ["a", "b", "c", "d"] and lookup.next_cursor([], after) == after


def brute_trails(edges, start, depth):
    out, level = [], [([start], [])]
    for _ in range(depth):
        level = [(n + [b], used + [(a, t, b)]) for n, used in level for a, b, t in edges if a == n[-1] and (a, t, b) not in used]
        out += level
    return sorted(">".join(n) + "/" + ">".join(t for _, t, _ in u) for n, u in out)


@pytest.mark.parametrize("seed", range(3))
def test_trails_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(rng.choice("abcde"), rng.choice("abcde"), rng.choice(["requires", "extends"])) for _ in range(14)})
    got = traverse.trails(relations(spark, edges), "a", 3)
    assert sorted(">".join(r.nodes) + "/" + ">".join(r.kinds) for r in got.collect()) == brute_trails(edges, "a", 3)
    for end in "bcde":
        paths = [p.split("/")[0] for p in brute_trails(edges, "a", 3) if p.split("/")[0].endswith(end)]
        best = min(((p.count(">"), p) for p in paths), default=None)
        row = traverse.shortest_path(relations(spark, edges), "a", end).first()
        assert (None if row is None else (row.length, row.path)) == best


def test_first_trails_are_the_first_of_all(spark):
    rng = random.Random(11)
    edges = sorted({(rng.choice(names), rng.choice(names), rng.choice(["requires", "extends"])) for names in [["a", "b", "bc", "c", "a|b"]] for _ in range(18)} | {("a", f"leaf{k:02}", "requires") for k in range(5)})
    rows = relations(spark, edges)
    for limit in (1, 4, 9, 30):
        every = traverse.trails(rows, "a", 3).orderBy("length", F.array_join("nodes", "|"), F.array_join("kinds", "|")).limit(limit)
        got = traverse.first_trails(rows, "a", 3, limit=limit)
        assert sorted(map(str, got.select(*every.columns).collect())) == sorted(map(str, every.collect()))


def test_long_chains_take_few_rounds(spark, monkeypatch):
    chain = spark.range(1, 10_000).select(F.format_string("n%05d", F.col("id") - 1).alias("src"), F.format_string("n%05d", "id").alias("dst")).coalesce(4)
    rounds, plain = [], traverse.checkpointed
    monkeypatch.setattr(traverse, "checkpointed", lambda df: rounds.append(1) or plain(df))
    assert traverse.reachable(spark.createDataFrame([("n00010",)], "node string"), chain).count() == 9_990
    assert len(rounds) <= 22


def test_depth_is_clamped_and_ends_are_told(small):
    e, r, _ = small
    assert max(x.length for x in traverse.trails(r, "a", 9).collect()) == 3
    assert [x.id for x in traverse.traverse(e, r, "d", 0)[0].collect()] == ["d"]
    assert traverse.traverse(e, r, "d", 2)[0].count() == 0
    assert traverse.shortest_path(r, "a", "d").first() is None


def test_reachability_and_isolation(spark, small):
    e, r, _ = small
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(9)], "src string, dst string")
    assert traverse.reachable(spark.createDataFrame([("n4",)], "node string"), chain).count() == 6
    assert [x.id for x in traverse.isolated(e, r).collect()] == ["d"]


def test_long_chains_and_rings_are_reached_to_the_end(spark):
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(70)] + [("n70", "n3")], "src string, dst string").coalesce(1)
    assert traverse.reachable(spark.createDataFrame([("n0",)], "node string").coalesce(1), chain).count() == 71


# -- audit -----------------------------------------------------------------
def graph(spark, **changes):
    """A clean book with one of everything; ``changes`` replace tables' rows."""
    rows = {
        "book": [("b", 10)], "chapter": [("b", 1, "One", 1)], "section": [("b|1|One", "s", "S", 2, 2)], "chunk": [(0, "b", 1, 2), (1, "b", 2, 3)],
        "entity": [("x", "X", "tool", 1), ("y", "Y", "tool", 1)],
        "edges": [("CONTAINS", "Book", "b", "Chapter", "b|1|One", None, None, None), ("HAS_SECTION", "Chapter", "b|1|One", "Section", "s", None, None, None), ("HAS_CHUNK", "Section", "s", "Chunk", "b|0", None, None, None), ("HAS_CHUNK", "Chapter", "b|1|One", "Chunk", "b|1", None, None, None),
                  ("MENTIONS", "Chunk", "b|0", "Entity", "x", None, 1, 0), ("MENTIONS", "Chunk", "b|0", "Entity", "y", None, 1, 0), ("RELATED", "Entity", "x", "Entity", "y", "requires", 1, 0)],
    } | changes
    kinds = {"book": "id string, page_count int", "chapter": "book_id string, number int, title string, page_start int", "section": "chapter_key string, key string, title string, level int, page_start int", "chunk": "chunk_index long, book_id string, page_start int, page_end int", "entity": "id string, name string, type string, source_page int", "edges": "type string, src_label string, src string, dst_label string, dst string, kind string, source_page int, chunk_index long"}
    return audit.Graph(*(spark.createDataFrame(rows[k], kinds[k]) for k in ("book", "chapter", "section", "chunk", "entity", "edges")))


CLEAN = dict(edges=[("CONTAINS", "Book", "b", "Chapter", "b|1|One", None, None, None), ("HAS_SECTION", "Chapter", "b|1|One", "Section", "s", None, None, None), ("HAS_CHUNK", "Section", "s", "Chunk", "b|0", None, None, None), ("HAS_CHUNK", "Chapter", "b|1|One", "Chunk", "b|1", None, None, None), ("MENTIONS", "Chunk", "b|0", "Entity", "x", None, 1, 0), ("MENTIONS", "Chunk", "b|0", "Entity", "y", None, 1, 0), ("RELATED", "Entity", "x", "Entity", "y", "requires", 1, 0)])["edges"]
CORRUPT = {
    "HIERARCHY_CHAPTER_BOOK_PARENT": {"edges": CLEAN[1:]},
    "HIERARCHY_SECTION_PARENT": {"edges": CLEAN[:1] + CLEAN[2:]},
    "HIERARCHY_CHUNK_PARENT_REQUIRED": {"edges": CLEAN[:3] + CLEAN[4:]},
    "HIERARCHY_CHUNK_MULTIPLE_PARENT": {"edges": [*CLEAN, ("HAS_CHUNK", "Chapter", "b|1|One", "Chunk", "b|0", None, None, None)]},
    "HIERARCHY_LEVEL_CONTRADICTION": {"section": [("b|1|One", "s", "S", -1, 2)]},
    "ENDPOINT_RELATED_INVALID": {"edges": [*CLEAN, ("RELATED", "Entity", "x", "Chunk", "b|0", "extends", 1, 0)]},
    "ENDPOINT_MENTIONS_INVALID": {"edges": [*CLEAN, ("MENTIONS", "Chunk", None, "Entity", "x", None, 1, 0)]},
    "ENDPOINT_HIERARCHY_INVALID": {"edges": [*CLEAN, ("CONTAINS", "Chapter", "b|1|One", "Section", "s", None, None, None)]},
    "ENTITY_UNMENTIONED": {"edges": CLEAN[:5] + CLEAN[6:]},
    "ENTITY_ISOLATED_RELATED": {"entity": [("x", "X", "tool", 1), ("y", "Y", "tool", 1), ("z", "Z", "tool", 1)]},
    "PROVENANCE_ENTITY_MISSING": {"entity": [("x", "X", "tool", 1), ("y", "Y", "tool", None)], "edges": CLEAN[:5] + CLEAN[6:]},
    "PROVENANCE_RELATIONSHIP_MISSING": {"edges": [*CLEAN[:6], ("RELATED", "Entity", "x", "Entity", "y", "requires", 1, None)]},
    "PROVENANCE_MENTIONS_MISSING": {"edges": [*CLEAN[:5], ("MENTIONS", "Chunk", "b|0", "Entity", "y", None, None, None), CLEAN[6]]},
    "PROVENANCE_CHUNK_MISSING": {"chunk": [(0, "b", 1, 2), (1, None, 2, 3)]},
    "DUPLICATE_ENTITY_LOGICAL": {"entity": [("x", "X", "tool", 1), ("y", "X", "tool", 1)]},
    "DUPLICATE_RELATIONSHIP_LOGICAL": {"edges": [*CLEAN, CLEAN[6]]},
    "PAGE_CHUNK_INVALID_RANGE": {"chunk": [(0, "b", 1, 2), (1, "b", 3, 2)]},
    "PAGE_CHAPTER_INVALID_START": {"chapter": [("b", 1, "One", 11)]},
    "PAGE_SECTION_INVALID_START": {"section": [("b|1|One", "s", "S", 2, 0)]},
}


@pytest.mark.parametrize("rule", sorted(audit.RULES))
def test_each_rule_finds_its_one_violation(spark, rule):
    assert audit.RULES[rule](graph(spark, **CORRUPT[rule])).count() == 1
    assert audit.RULES[rule](graph(spark)).count() == 0


def test_states_and_samples(spark):
    f = lambda s, n: {"severity": s, "total": n}
    assert audit.overall([f("blocking", 0), f("warning", 3)]) == "passed"
    assert audit.overall([f("blocking", 1)]) == "violations"
    assert audit.overall([f("blocking", 1), f("incomplete", 1)]) == "incomplete"
    assert audit.overall([], states=["failed", "unreachable"]) == "unreachable" and audit.overall([], "failed") == "failed"
    assert [audit.EXIT_CODES[s] for s in ("passed", "violations", "incomplete", "unreachable", "failed")] == [0, 10, 11, 12, 13]
    many = graph(spark, entity=[(f"e{k:02}", f"E{k}", "tool", 1) for k in range(30)])
    row = audit.finding(many, "ENTITY_ISOLATED_RELATED", 3).first()
    assert (row.total, row.samples, row.truncated, row.severity) == (30, "e00;e01;e02", True, "incomplete")


# -- store -----------------------------------------------------------------
def test_upserts_are_idempotent_and_last_wins(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path))
    first = entities(spark, [("a", "one", "tool", ["x"]), ("b", "two", "tool", [])])
    s.upsert("entity", first)
    twice = entities(spark, [("a", "old", "tool", []), ("a", "new", "tool", ["y"])]).withColumn("seq", F.when(F.col("name") == "new", 2).otherwise(1))
    for _ in range(2):
        s.upsert("entity", twice, order="seq")
        assert sorted((r.id, r.name, tuple(r.aliases)) for r in s.read("entity").collect()) == [("a", "new", ("y",)), ("b", "two", ())]


def test_a_killed_write_leaves_the_last_version(spark, tmp_path, monkeypatch):
    rows = lambda *ids: spark.createDataFrame([(i, i.upper(), "tool", None, 1, [], None) for i in ids], schema.ENTITY)
    s = store.TableStore(spark, str(tmp_path / "g"))
    s.upsert("entity", rows("a"))
    with monkeypatch.context() as m, pytest.raises(RuntimeError):  # between data and pointer
        m.setattr(store.TableStore, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        s.upsert("entity", rows("b"))
    assert [r.id for r in s.read("entity").collect()] == ["a"]
    number, _ = s.version("entity")
    path, fs = s._file("entity", "_versions", f"{number + 1:012d}")
    fs.create(path, False).close()  # killed while the pointer was written
    assert [r.id for r in s.read("entity").collect()] == ["a"]
    s.upsert("entity", rows("c"))
    assert sorted(r.id for r in s.read("entity").collect()) == ["a", "c"]


def test_writers_that_meet_are_told(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(i, i.upper(), "tool", None, 1, [], None) for i in ids], schema.ENTITY)
    s = store.TableStore(spark, str(tmp_path / "g"))
    at = s.version("entity")
    s.write("entity", rows("a"), after=at)
    with pytest.raises(store.ConcurrentWrite):
        s.write("entity", rows("b"), after=at)
    assert [r.id for r in s.read("entity").collect()] == ["a"]
    for k in range(4):
        s.upsert("entity", rows("a", f"x{k}"))
    assert s.read("entity").count() == 5 and len(s._pointers("entity")) <= 3


def test_of_rows_with_one_key_the_last_counts(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path / "g"))
    s.upsert("entity", spark.createDataFrame([("a", f"name {k}", "tool", None, k, [], None) for k in range(50)], schema.ENTITY).coalesce(1))
    assert s.read("entity").first().name == "name 49"


def test_relations_split_and_policies(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path / "t"))
    s.upsert("entity", entities(spark, [("a", "A", "tool", []), ("b", "B", "tool", [])]))
    rows = relations(spark, [("a", "b", "requires"), ("a", "zz", "requires"), ("yy", "b", "extends"), ("yy", "zz", "extends")])
    with pytest.raises(ValueError, match="yy, zz"):
        s.upsert_relations(rows, "fail_loud")
    assert s.read("related").count() == 0
    letters = str(tmp_path / "letters")
    assert s.upsert_relations(rows, dead_letters=letters) == 3 and s.read("related").count() == 1
    got = spark.read.json(letters)
    assert sorted(r.missing_endpoint for r in got.collect()) == ["both", "source", "target"] and store.line_count(spark, letters) == 3
    assert store.line_count(spark, str(tmp_path / "none")) == 0
    (tmp_path / "q.jsonl").write_text('{"question": "a?", "n": 1}\n\n   \n{"question": "b?"}\n')
    assert [tuple(r) for r in store.read_jsonl(spark, str(tmp_path / "q.jsonl"), "question string, n int").collect()] == [("a?", 1), ("b?", None)]


def test_mentions_need_their_chunk_null_safe(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path))
    s.upsert("entity", entities(spark, [("a", "A", "tool", [])]).withColumn("source_page", F.lit(9)))
    s.upsert("chunk", spark.createDataFrame([(1, None, "t", 1, 1), (2, "b", "t", 1, 1)], schema.CHUNK))
    s.upsert_mentions(mentions(spark, [(1, None, "a"), (2, "b", "a"), (3, "b", "a"), (2, "b", "nope")]))
    assert sorted(((r.chunk_index, r.book_id, r.source_page) for r in s.read("mentions").collect())) == [(1, None, 9), (2, "b", 9)]


def test_snapshot_restore_and_clear(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path / "t"))
    s.upsert("entity", entities(spark, [("a", "A", "tool", ["q"]), ("b", "B", "tool", [])]))
    s.upsert_relations(relations(spark, [("a", "b", "requires"), ("a", "b", "extends")]))
    s.snapshot(str(tmp_path / "snap"))
    before = s.counts()
    s.clear()
    assert sum(s.counts().values()) == 0
    s.restore(str(tmp_path / "snap"))
    assert s.counts() == before and {r.type for r in s.read("related").collect()} == {"requires", "extends"}
    assert store.verify_counts(before, before | {"mentions": 1, "chunk": 101}, 100) == []
    assert len(store.verify_counts({"entity": 3}, {"entity": 2, "chunk": 50, "mentions": 0}, 100)) == 3


# -- migration -------------------------------------------------------------
def test_migration(spark):
    e = entities(spark, [("react", "ReAct", "pattern", None), ("react-pattern", "ReAct Pattern", "pattern", None), ("other", "Other", "pattern", None)])
    r, m = relations(spark, [("react", "other", "requires")]), mentions(spark, [(1, "b", "react")])
    after, edges, men, collisions, n = migrate.migrate(e, r, m)
    assert {x.id for x in after.collect()} == {"react-pattern", "react-pattern-pattern", "other-pattern"} and n == 3 and collisions.count() == 0
    assert [(x.src, x.dst) for x in edges.collect()] == [("react-pattern", "other-pattern")] and men.first().entity_id == "react-pattern"
    assert all(x.aliases == [] and x.canonical_name == x.name for x in after.collect())
    again = migrate.migrate(after, edges, men)
    assert again[4] == 0
    blocked = entities(spark, [("react", "ReAct", "pattern", []), ("react-pattern", "ReAct", "pattern", [])])
    *_, collisions, n = migrate.migrate(blocked, r.limit(0), m.limit(0))
    assert n == 0 and collisions.count() == 1


# -- communities -----------------------------------------------------------
def test_simple_graph(spark):
    e = entities(spark, [("a", "A", "agent", []), ("b", "B", "agent", []), ("c", "C", "concept", [])])
    r = relations(spark, [("a", "b", "requires"), ("b", "a", "enables"), ("a", "missing", "requires"), ("c", "c", "extends")])
    assert sorted(tuple(x) for x in community.simple_graph(e, r).collect()) == [("a", "b"), ("c", "c")]


def cliques(spark, n=4, size=6):
    rows = [(f"{g}{i}", f"{g}{j}") for g in "pqrs"[:n] for i in range(size) for j in range(i + 1, size)]
    return spark.createDataFrame([*rows, ("p0", "q0"), ("q1", "r0"), ("r1", "s0")], "a string, b string")


def test_leiden_finds_cliques_and_repeats(spark):
    edges = cliques(spark)
    labels = community.communities(edges, 1.0)
    got = {r.node: r.community for r in labels.collect()}
    assert len(got) == 24 and all(len({got[f"{g}{i}"] for i in range(6)}) == 1 for g in "pqrs") and len(set(got.values())) == 4
    assert got == {r.node: r.community for r in community.communities(edges, 1.0).collect()}
    assert community.modularity(edges, labels) > 0.6


def properties(edges, found, resolution):
    """Communities are connected, and no node gains by a move: to a neighbour's community or to one of its own."""
    links = [tuple(r) for r in edges.collect()]
    m, near, degree, members = len(links), {}, {}, {}
    for a, b in links:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        if a != b:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    for n, c in found.items():
        members.setdefault(c, set()).add(n)
    assert set(found) == set(degree) and all(min(own) == c for c, own in members.items())
    weight = {c: sum(degree[n] for n in own) for c, own in members.items()}
    for own in members.values():
        seen, todo = set(), [min(own)]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [x for x in near.get(n, []) if x in own]
        assert seen == own
    for n, c in found.items():
        to = {c: 0}
        for x in near.get(n, []):
            to[found[x]] = to.get(found[x], 0) + 1
        gain = lambda k: to.get(k, 0) - resolution * degree[n] * (weight[k] - degree[n] * (k == c)) / (2 * m)  # noqa: B023, E731
        assert max([0, *map(gain, to)]) <= gain(c) + 1e-6


def test_communities_are_as_good_as_in_one_process(spark):
    from .leiden_twin import leiden

    rng = random.Random(5)
    rows = {(f"n{min(x, y):03}", f"n{max(x, y):03}") for g in range(12) for _ in range(60) for x, y in [(g * 15 + rng.randrange(15), g * 15 + rng.randrange(15))]}
    rows |= {tuple(sorted((f"n{rng.randrange(180):03}", f"n{rng.randrange(180):03}"))) for _ in range(60)} | {("z1", "z2"), ("z3", "z3")}
    edges = spark.createDataFrame(sorted(rows), "a string, b string").coalesce(2).cache()
    resolutions = {1: 0.1, 2: 1.0, 3: 8.0}
    found = {}
    for r in community.leiden.partitions(edges, resolutions).collect():
        found.setdefault(r.level, {})[r.node] = r.community
    for level, resolution in resolutions.items():
        properties(edges, found[level], resolution)
        label = lambda x: spark.createDataFrame(list(x.items()), "node string, community string")
        whole = leiden(sorted(rows), resolution, len(rows))
        assert community.modularity(edges, label(found[level]), resolution) >= community.modularity(edges, label(whole), resolution) - 0.01
    assert len(set(found[1].values())) < len(set(found[2].values())) < len(set(found[3].values()))


def test_communities_of_odd_graphs(spark):
    star = spark.createDataFrame([("hub", f"leaf{k:02}") for k in range(30)] + [("loop", "loop")], "a string, b string")
    properties(star, {r.node: r.community for r in community.communities(star, 1.0).collect()}, 1.0)
    assert community.communities(star.limit(0), 1.0).collect() == []


def test_community_ids_parents_and_budget(spark):
    members = spark.createDataFrame([(1, "x", "b"), (1, "x", "a")], "level int, community string, entity string")
    import hashlib

    assert community.named(members).first().id == hashlib.sha1(b"1:a,b").hexdigest()[:16]
    children = spark.createDataFrame([("c", "1"), ("c", "2"), ("d", "9")], "id string, entity string")
    parents = spark.createDataFrame([("p", 0, "1"), ("q", 1, "2"), ("q", 1, "7")], "id string, ordinal int, entity string")
    assert {r.id: r.parent_id for r in community.assign_parents(children, parents).collect()} == {"c": "p", "d": "p"}
    with pytest.raises(schema.CommunityDetectionError):
        community.check_budget(151, 150)


def test_summaries_pack_and_recurse():
    calls = []

    def call(text):
        calls.append(text)
        return text[:10]

    assert community.summarise_lines(["short"], call) == "short" and len(calls) == 1
    calls.clear()
    community.summarise_lines(["x" * 2000] * 12, call, tokens=1000)
    assert len(calls) > 2 and max(map(len, calls)) <= 4001 and "Sub-summary 1: " in calls[-1]
    community.summarise_lines(["y" * 9000] * 3, call, tokens=1000)


def test_summaries_in_spark_are_those_of_one_process(spark, monkeypatch):
    draw, cases = random.Random(6), {}
    cases |= {"short": ["short"], "long": ["x" * 2000] * 12, "stuck": ["y" * 9000] * 3, "mixed": ["z" * draw.randrange(3000) for _ in range(40)], "many": [f"line {k}" * 20 for k in range(600)]}
    call = lambda text: f"{len(text)}:{text[:40]}"
    rows = [(i, f"{k:05}", line) for i, own in cases.items() for k, line in enumerate(own)]
    draw.shuffle(rows)
    lines = spark.createDataFrame(rows, "id string, pos string, line string")
    got = {r.id: r.summary for r in community.summarise(lines, call, 1000).collect()}
    assert got == {i: community.summarise_lines(own, call, 1000) for i, own in cases.items()}
    # blocks of lines go to tasks of their own, and no text is longer than a call may be
    monkeypatch.setattr(community, "PACK_LINES", 100)
    packs = community.packed(lines, 4000).collect()
    assert all(len(p.text) <= 4000 or p.lines == 1 for p in packs) and sum(p.lines for p in packs) == len(rows)
    many = sorted((p.n, p.text) for p in packs if p.id == "many")
    assert [n for n, _ in many] == list(range(1, len(many) + 1)) and "\n".join(t for _, t in many).split("\n") == cases["many"]


def test_bottom_up_summaries(spark):
    e = entities(spark, [("a", "A", "agent", []), ("b", "B", "agent", [])])
    members = spark.createDataFrame([(3, "L3", "a"), (3, "L3", "b"), (0, "L0", "a"), (0, "L0", "b")], "level int, id string, entity string")
    parents = spark.createDataFrame([("L3", "L0")], "id string, parent_id string")
    got = {r.id: r.summary for r in community.summarise_levels(members, e, spark.createDataFrame([("a", "b")], "a string, b string"), parents, lambda t: f"<{t}>").collect()}
    assert got["L3"] == "<A: about A\nB: about B\na - b>" and got["L0"] == f"<{got['L3']}>"
    done = spark.createDataFrame([("L3", "x"), ("L0", " ")], "id string, summary string")
    level = spark.createDataFrame([("L3",), ("L0",)], "id string")
    assert [r.id for r in community.to_summarise(level, done).collect()] == ["L0"]


def test_global_question(spark):
    rows = spark.createDataFrame([(f"s{k}", 1, text, ["x"], None) for k, text in enumerate(["agents use tools", "nothing", "tools"])], schema.SUMMARY)
    out = evaluate.ask_global(rows, "which tools do agents use", 1, 2)
    assert out["citations"] == ["s0", "s2"] and evaluate.ask_global(rows, "q", 2)["citations"] == []
    with pytest.raises(ValueError, match="level"):
        evaluate.ask_global(rows, "q", 4)
    assert evaluate.kept_indices([3, 1, 1, -1, 9], 4) == [1, 3]


# -- extraction ------------------------------------------------------------
def test_indexing_end_to_end(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "b", "agent uses tool", 1, 1), (1, "b", "boom", 2, 2), (2, None, "tool alone", 3, 3)], schema.CHUNK)
    base = extract.lexicon_extractor({"agent": "agent", "tool": "tool"})

    def extractor(text):
        if text == "boom":
            raise RuntimeError("bad chunk")
        return base(text)

    s = store.TableStore(spark, str(tmp_path / "t"))
    for _ in range(2):
        out = extract.index_chunks(s, chunks, extractor, str(tmp_path / "dead"), str(tmp_path / "orphans"))
        assert out == {"chunks": 3, "failed": 1, "orphans": 0}
        assert s.counts() == {"book": 0, "chapter": 0, "section": 0, "hierarchy": 0, "chunk": 3, "entity": 2, "related": 1, "mentions": 3, "summary": 0}
    assert s.read("related").first().chunk_index == 0
    assert {r.error_type for r in spark.read.json(str(tmp_path / "dead")).collect()} == {"RuntimeError"}


def test_names_resolve_to_the_later_entity(spark):
    e = spark.createDataFrame([(0, "b", 0, "old", "X", ["Ex"], None), (0, "b", 1, "new", "x", [], "Canon")], "chunk_index long, book_id string, pos int, id string, name string, aliases array<string>, canonical_name string")
    assert {r.key: r.id for r in extract.name_map(e).collect()} == {"x": "new", "ex": "old", "canon": "new"}


# -- books -----------------------------------------------------------------
def pages(n):
    return [f"page {k + 1}" for k in range(n)]


def test_slices():
    assert [len(x) for x in books.slices("a" * 1000, 500, 100)] == [500, 500, 200]
    assert [len(x) for x in books.slices("a" * 800, 500, 100)] == [500, 400] and books.slices("", 500, 100) == []
    with pytest.raises(ValueError, match="overlap"):
        books.slices("a", 5, 5)


def test_slices_in_spark(spark):
    df = spark.createDataFrame([("a" * 1000,), ("a" * 800,), ("",), ("é" * 10,)], "t string")


def test_nested_toc():
    toc = [(1, "1", 1), (2, "Root", 2), (3, "Parent", 3), (4, "Leaf A", 4), (4, "Leaf B", 6), (3, "Sibling", 8), (4, "Leaf C", 9)]
    rows = books.cut_book("b", 12, toc, pages(12))
    assert [(r[4], r[6], r[7], r[8]) for r in rows] == [("Leaf A", "Root>Parent", 4, 5), ("Leaf B", "Root>Parent", 6, 7), ("Leaf C", "Root>Sibling", 9, 12)]
    assert {r[2] for r in rows} == {1} and [r[1] for r in rows] == [0, 1, 2]


def test_toc_rules():
    assert books.merge_split_titles([(1, "1", 3), (1, "Start", 3), (1, "2", 5), (1, "3", 5)]) == [(1, "1 Start", 3), (1, "2", 5), (1, "3", 5)]
    toc = [(1, "Preface", 1), (1, "1. Intro", 3), (1, "Loose", 5), (1, "2 Next", 7)]
    rows = books.cut_book("b", 9, toc, pages(9))
    assert [(r[2], r[3], r[7], r[8]) for r in rows] == [(1, "Intro", 3, 4), (1, "Intro", 5, 6), (2, "Next", 7, 9)]
    assert [r[7:9] for r in books.cut_book("b", 3, [], pages(3))] == [(1, 3)]
    assert books.cut_book("b", 4, [(1, "Unnumbered", 1)], pages(4)) == []
    long = books.cut_book("b", 1, [(1, "1 A", 1)], ["z" * 4000])
    assert [len(r[-1]) for r in long] == [1500, 1500, 1300]


def test_books_in_spark(spark):
    rows = [("b1", 2, [(1, "1 A", 1), (1, "2 B", 2)], pages(2)), ("b2", 1, None, ["t"])]
    df = spark.createDataFrame(rows, "book_id string, page_count int, toc array<struct<level:int,title:string,page:int>>, pages array<string>")
    cut = books.cut_books(df)
    assert sorted((r.book_id, r.chunk_index, r.chapter_number) for r in cut.collect()) == [("b1", 0, 1), ("b1", 1, 2), ("b2", 0, None)]
    parts = books.editorial(cut)
    assert parts["chapter"].count() == 2 and parts["chunk"].count() == 3


# -- text to query, log ----------------------------------------------------
def test_text_query_heals_and_guards(spark):
    spark.range(200).createOrReplaceTempView("numbers")
    told = []

    def generate(question, shape, failure):
        told.append(failure)
        return "SELECT nope FROM numbers" if failure is None else "SELECT id, 'DROP TABLE x' AS words FROM numbers"

    assert textquery.ask(spark, "q", ["numbers"], generate, timeout=60).count() == 100 and told[0] is None and "nope" in told[1]
    with pytest.raises(schema.QueryGenerationError):
        textquery.ask(spark, "q", ["numbers"], lambda *_: "SELECT nope FROM numbers", timeout=60)
    for bad in ("DROP TABLE numbers", "INSERT INTO numbers VALUES (1)", "CREATE TABLE t AS SELECT 1", "SET x=1", "WITH a AS (SELECT 1) INSERT INTO numbers SELECT * FROM a"):
        with pytest.raises(schema.UnsafeQuery):
            textquery.check_read_only(spark, bad)
    assert "numbers" in textquery.explain(spark, "SELECT * FROM numbers") or textquery.explain(spark, "SELECT 1")


def test_log(spark, tmp_path):
    now = datetime(2024, 5, 10, 12, tzinfo=timezone.utc)
    rows = [query_log.entry("find_entity", "entity", {"name": "x"}, 0, 1.5, now=now), query_log.entry("search", "chunks", {}, 3, 2.5, now=datetime(2024, 5, 1, tzinfo=timezone.utc))]
    assert rows[0]["entity_not_found"] and not rows[1]["zero_results"]
    path = str(tmp_path / "log")
    query_log.append(spark, rows, path)
    assert query_log.apply_retention(spark, path, date(2024, 5, 10)) == ["2024-05-01"]
    assert spark.read.schema(schema.QUERY_LOG).json(path).count() == 1
    out = str(tmp_path / "out")
    query_log.append(spark, [query_log.entry("find_entity", "entity", {}, 1, 1.0, now=datetime(2024, 5, 20, tzinfo=timezone.utc))], path)
    query_log.stream_daily(spark, f"{path}/*", out, str(tmp_path / "cp")).awaitTermination(120)
    days = spark.createDataFrame([(date(2024, 1, d), s) for d, s in enumerate([1.0, 0.5, 0.5, 0.5, 1.0, 0.5], 1)], "day date, score double")
    assert [(r["first"], r.length) for r in query_log.alerts(days, 1.0).collect()] == [(date(2024, 1, 2), 3)]


def test_stream_upserts_change_nothing_when_replayed(spark, tmp_path):
    s = store.TableStore(spark, str(tmp_path / "t"))
    entities(spark, [("a", "A", "tool", []), ("b", "B", "tool", [])]).write.json(str(tmp_path / "in"))
    for k in range(2):
        query_log.stream_upserts(spark, str(tmp_path / "in"), s, "entity", schema.ENTITY, str(tmp_path / f"cp{k}")).awaitTermination(120)
        assert s.read("entity").count() == 2


def test_retrieval_metrics(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "question string, item string")
    got = {r.question: (r.precision, r.recall, r.f1) for r in evaluate.retrieval_metrics(pairs([("q", "a"), ("q", "b")]), pairs([("q", "a"), ("r", "z")])).collect()}
    assert got == {"q": (0.5, 1.0, pytest.approx(2 / 3)), "r": (0.0, 0.0, 0.0)}


def test_questions_are_made_and_told_apart(spark):
    qs = ["What is an agent?", "what is AN agent", "How do tools work?", "", "What is a tool?"]
    assert evaluate.distinct_questions(qs) == [qs[0], qs[2], qs[3], qs[4]]
    assert evaluate.distinct_questions(qs, lambda x: [9, 2, 2, 0, -1]) == [qs[0], qs[2]]
    chunks = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None)], "chunk_index long, text string")

    def generate(text):
        if text == "boom":
            raise RuntimeError
        return [{"question": f"{text}?", "answer": text}, {"question": " "}]

    assert [tuple(r) for r in evaluate.generated_questions(chunks, generate).orderBy("chunk_index").collect()] == [(1, 0, "a?", "a"), (3, 0, "?", "")]


def test_evaluation_is_written_with_deltas(spark, tmp_path):
    m = lambda *rows: spark.createDataFrame(rows, "metric string, value double")
    evaluate.write_evaluation(spark.createDataFrame([("q", 1.0)], "question string, f1 double"), m(("f1", 0.5), ("new", 1.0)), m(("f1", 0.25)), str(tmp_path / "e"))
    got = {r.metric: (r.value, r.baseline, r.delta) for r in spark.read.json(f"{tmp_path}/e/metrics").collect()}
    assert got == {"f1": (0.5, 0.25, 0.25), "new": (1.0, None, None)} and spark.read.json(f"{tmp_path}/e/results").count() == 1


def test_places_of_stores():
    for good in ("/data/g", "hdfs://host:9000/a/b-1", "relative/x_2", "s3a://bucket/store"):
        assert schema.safe_store(good) == good
    for bad in ("ftp://h/x", "hdfs://user:pw@h/x", "/a?token=1", "/a/../b", "/a b", "", "http://x/y", "/x#y"):
        with pytest.raises(ValueError):
            schema.safe_store(bad)
