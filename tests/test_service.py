"""Dispatch, metadata, logging and the command line."""

import json

import pytest

from graphloom import __main__ as cli
from graphloom import schema
from graphloom.operators.store import TableStore
from graphloom.plans import service as V

from .test_graph import entities, mentions, relations


@pytest.fixture(scope="module")
def tables(spark):
    e = entities(spark, [("a", "Alpha", "agent", []), ("b", "Beta", "tool", ["MCP"])])
    c = spark.createDataFrame([(0, "k", "alpha meets beta", 1, 1), (1, "k", "gamma", 2, 2)], schema.CHUNK)
    s = spark.createDataFrame([("s1", 1, "alpha tools", ["a"], "s0")], schema.SUMMARY)
    return V.Tables(e, relations(spark, [("a", "b", "requires")]), mentions(spark, [(0, "k", "a")]), c, s)


def test_every_tool_answers_and_is_logged(spark, tables):
    log = []
    g = V.GraphService(tables, log.append)
    assert [r.id for r in g.execute(V.EntityQuery("Alpha")).rows["entities"]] == ["a"]
    assert g.execute(V.RelationQuery("a", 7)).depth == 3 and g.execute(V.RelationQuery("a", -1)).depth == 0
    assert g.execute(V.PathQuery("a", "b", 9)).rows["paths"][0].path == "a>b"
    assert g.execute(V.BatchEntityQuery(("b", "zz"))).total == 1
    assert [r.chunk_index for r in g.search_chunks("beta").rows["chunks"]] == [0]
    page = g.list_entities(size=1)
    assert page.cursor == "a" and g.list_entities(page.cursor, 1).cursor == "b" and g.list_entities("b").cursor == "b"
    assert g.count_entities() == 2 and g.count_entities("tool") == 1
    assert g.search_rag("Alpha").total == 3 and g.ask_global("alpha").rows["citations"] == ["s1"]
    assert g.query_text(spark, "how many", lambda *_: "SELECT count(*) AS n FROM graph_entities", 60).rows["rows"][0].n == 2
    assert g.contexts("Alpha") == ["alpha meets beta", "about Alpha"]
    g.find_entity("nobody")
    assert log[-1]["entity_not_found"] and all(x["error"] is None for x in log)
    for bad in (V.SimilarityQuery(), V.CommunityQuery("q")):
        with pytest.raises(schema.UnsupportedQueryType):
            g.execute(bad)
    with pytest.raises(schema.BatchSizeExceeded):
        g.find_batch(["x"] * 201)
    assert "BatchSizeExceeded" in log[-1]["error"]


def test_layout(spark, tables, tmp_path):
    V.optimise_layout(tables, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/entity_terms/postings").where("term = 'mcp'").count() == 1


def test_a_stores_searches_read_its_index(spark, tmp_path, monkeypatch):
    from graphloom import schema
    from graphloom.operators import extract, search

    s = TableStore(spark, str(tmp_path / "s"), buckets=4)
    chunks = lambda *rows: spark.createDataFrame([(k, "b", text, 1, 1) for k, text in rows], schema.CHUNK)
    extract.upsert_chunks(s, chunks((1, "agent plan"), (2, "tool"), (3, "agent agent")))
    extract.upsert_chunks(s, chunks((2, "agent tool"), (3, "nothing"), (4, "agent")))
    monkeypatch.setattr(search, "bm25", lambda *_: (_ for _ in ()).throw(AssertionError("the texts are read")))
    service = V.GraphService(V.Tables.of_store(s))
    got = service.search_chunks("agent").rows["chunks"]
    assert sorted(r.chunk_index for r in got) == [1, 2, 4] and got[0].chunk_index == 4 and got[0].text == "agent"
    monkeypatch.undo()
    s.upsert("chunk", chunks((5, "agent")))  # past the index: searches read the texts again, until it is built anew
    assert V.Tables.of_store(s).index is None and len(V.GraphService(V.Tables.of_store(s)).search_chunks("agent").rows["chunks"]) == 4
    extract.upsert_chunks(s, chunks((6, "agent")))
    assert len(V.GraphService(V.Tables.of_store(s)).search_chunks("agent").rows["chunks"]) == 5


def test_command_line(spark, tables, tmp_path, capsys):
    store = TableStore(spark, str(tmp_path / "s"))
    store.upsert("entity", tables.entities)
    assert cli.main(["query", "--store", str(tmp_path / "s"), "--type", "entity", "--params", '{"name": "Alpha"}']) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["total"] == 1
    assert cli.main(["query", "--store", "x", "--type", "entity", "--params", "{"]) == 2
    assert cli.main(["query", "--store", str(tmp_path / "s"), "--type", "batch_entity", "--params", json.dumps({"ids": ["x"] * 300})]) == 3
    spark.createDataFrame([(1, "agent uses tool", "k")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    assert cli.main(["index", "--store", str(tmp_path / "t"), "--documents", str(tmp_path / "d"), "--lexicon", '{"agent": "agent", "tool": "tool"}']) == 0
    assert TableStore(spark, str(tmp_path / "t")).read("related").count() == 1


def test_books_are_indexed_audited_and_summarised(spark, tmp_path, capsys, monkeypatch):
    """A book's own audit is clean, a broken one is found, communities stop at the budget and go on where they were."""
    toc = [(1, "1 Agents", 1), (2, "Tools", 2), (3, "Small tools", 2), (1, "2 Patterns", 3), (1, "Preface", 4)]
    rows = [("b", "Book", "A", 4, [{"level": a, "title": t, "page": p} for a, t, p in toc], ["agent tool", "tool pattern", "agent pattern", "nothing"])]
    spark.createDataFrame(rows, "book_id string, title string, author string, page_count int, toc array<struct<level:int,title:string,page:int>>, pages array<string>").write.parquet(str(tmp_path / "books"))
    where = str(tmp_path / "s")
    assert cli.main(["index", "--store", where, "--books", str(tmp_path / "books"), "--lexicon", '{"agent": "agent", "tool": "tool", "pattern": "pattern"}']) == 0
    store = TableStore(spark, where)
    assert {(r.type, r.dst) for r in store.read("hierarchy").collect()} >= {("CONTAINS", "b|1|Agents"), ("HAS_SECTION", "b|1|Tools"), ("HAS_SUBSECTION", "b|1|Small tools")}
    assert store.read("chunk").count() == 2 and store.read("book").first().page_count == 4
    capsys.readouterr()
    code = cli.main(["audit", "--store", where])
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (code, out["state"]) == (0, "passed"), [f for f in out["findings"] if f["total"]]
    assert out["runtime"]["nodes"]["Chunk"] == 2 and out["runtime"]["edges"]["HAS_CHUNK"] == 2
    store.upsert("chunk", spark.createDataFrame([(9, "https://secret", "x", 1, 1)], schema.CHUNK))
    assert cli.main(["audit", "--store", where]) == 10
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert next(f for f in out["findings"] if f["rule_id"] == "HIERARCHY_CHUNK_PARENT_REQUIRED")["total"] == 1 and "https" not in json.dumps(out)
    monkeypatch.setenv("GRAPHLOOM_COMMUNITY_MAX_CALLS", "1")
    assert cli.main(["communities", "--store", where]) == 4 and store.read("summary").count() == 0
    monkeypatch.setenv("GRAPHLOOM_COMMUNITY_MAX_CALLS", "50")
    assert cli.main(["communities", "--store", where]) == 0
    first = {r.id: r.summary for r in store.read("summary").collect()}
    assert len(first) >= 2 and all(first.values())
    monkeypatch.setenv("GRAPHLOOM_COMMUNITY_MAX_CALLS", "0")  # all communities count, also those that have a summary
    assert cli.main(["communities", "--store", where]) == 4
    monkeypatch.setenv("GRAPHLOOM_CHUNK_SIZE", "10")
    assert cli.main(["communities", "--store", where]) == 2
