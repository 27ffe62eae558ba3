"""Settings that act: the log's retention, the time of a text query."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from graphloom import __main__ as cli, schema
from graphloom.operators.store import TableStore
from graphloom.plans import service
from graphloom.streaming import query_log


def test_log_in_a_folder_keeps_the_days_of_its_retention(spark, tmp_path):
    log, now = query_log.to_folder(spark, str(tmp_path / "log"), 3), datetime(2024, 5, 10, 23, 30, tzinfo=timezone.utc)
    for back in (9, 4, 3, 0):
        log(query_log.entry("find_entity", "entity", {"name": "ä\n"}, 0, 1.5, "no; such", now=now - timedelta(days=back)))
    rows = sorted(spark.read.schema(schema.QUERY_LOG).json(str(tmp_path / "log")).collect(), key=lambda r: r.ts)
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["date=2024-05-07", "date=2024-05-10"]
    assert [json.loads(r.query_params) for r in rows] == [{"name": "ä\n"}] * 2 and all(r.entity_not_found and r.error == "no; such" for r in rows)
    assert (rows[1].ts - rows[0].ts).days == 3


def test_queries_of_the_command_line_are_logged(spark, tmp_path, monkeypatch, capsys):
    where = str(tmp_path / "s")
    TableStore(spark, where).upsert("entity", spark.createDataFrame([("a-tool", "Alpha", "tool", "d", 1, [], None)], schema.ENTITY))
    (tmp_path / "s" / "_query_log" / "date=2020-01-01").mkdir(parents=True)
    monkeypatch.setenv("GRAPHLOOM_LOG_RETENTION_DAYS", "2")
    assert cli.main(["query", "--store", where, "--type", "entity", "--params", '{"name": "Alpha"}']) == 0
    assert cli.main(["query", "--store", where, "--type", "batch_entity", "--params", json.dumps({"ids": ["x"] * 300})]) == 3
    assert [p.name for p in (tmp_path / "s" / "_query_log").iterdir()] == [f"date={datetime.now(timezone.utc).date()}"]
    rows = spark.read.schema(schema.QUERY_LOG).json(f"{where}/_query_log").collect()
    assert sorted((r.result_count, bool(r.error)) for r in rows) == [(0, True), (1, False)]
    monkeypatch.setenv("GRAPHLOOM_LOG_RETENTION_DAYS", "0")
    assert cli.main(["query", "--store", where, "--type", "entity"]) == 2


def test_text_queries_take_the_time_of_the_settings(spark, monkeypatch):
    told, none = [], spark.createDataFrame([], "id string")
    monkeypatch.setattr(service.textquery, "ask", lambda s, q, names, generate, timeout: told.append(timeout) or none)
    made = service.GraphService(service.Tables(none, none, none, none), settings=schema.Settings(text_query_timeout=7))
    made.query_text(spark, "q", lambda *_: "SELECT 1")
    made.query_text(spark, "q", lambda *_: "SELECT 1", 3)
    assert told == [7, 3]
