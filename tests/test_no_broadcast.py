"""Members and ids may be many where their files are small, so plans do not send them to the driver."""

from __future__ import annotations

import pytest

from graphloom.operators import alike, community, store


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    members = [(f"n{k:02}", f"g{k % 3}") for k in range(20)]
    spark.createDataFrame(members, "node string, group string").write.parquet(f"{tmp_path}/members")
    spark.createDataFrame([(n,) for n, _ in members], "id string").write.parquet(f"{tmp_path}/ids")
    spark.createDataFrame([("n00", "n01", "t"), ("n03", "n00", "t"), ("n03", "n03", "t"), ("n01", "n00", "u"), ("n02", "gone", "t")], "src string, dst string, type string").write.parquet(f"{tmp_path}/related")
    return {t: spark.read.parquet(f"{tmp_path}/{t}") for t in ("members", "ids", "related")}


def test_pairs_and_orphans_stay_off_the_driver(tables):
    members, ids, related = (tables[t] for t in ("members", "ids", "related"))
    for df in (alike.pairs(members), store.split_orphans(related, ids)[0], community.simple_graph(ids, related, members)):
        assert "BroadcastExchange" not in planned(df.select("src", "dst") if "src" in df.columns else df)
    assert sorted((r.src, r.dst) for r in store.split_orphans(related, ids)[0].collect()) == [("n00", "n01"), ("n01", "n00"), ("n03", "n00"), ("n03", "n03")]


def test_a_large_group_is_made_in_parts(tables, monkeypatch):
    members, ids, related = (tables[t] for t in ("members", "ids", "related"))
    whole = sorted(tuple(r) for r in alike.pairs(members).select("src", "dst").collect())
    monkeypatch.setattr(alike, "SLICE", 2)
    assert whole == sorted(tuple(r) for r in alike.pairs(members).select("src", "dst").collect()) and len(whole) == 7 * 6 + 7 * 6 + 6 * 5
    simple = [tuple(r) for r in community.simple_graph(ids, related, members).collect()]
    assert sorted(simple) == sorted({x for x in whole if x[0] < x[1]} | {("n00", "n01"), ("n03", "n03")})
