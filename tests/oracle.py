"""Run a query and its DuckDB twin and compare rows, whatever their order."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> int:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    wanted = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == wanted[0], (got[0], wanted[0])
    assert len(got[1]) == len(wanted[1]), (len(got[1]), len(wanted[1]), got[1][:3], wanted[1][:3])
    bad = [(a, b) for a, b in zip(got[1], wanted[1]) if a != b and not same(a, b)]
    assert not bad, (len(bad), bad[:3])
    return len(got[1])


def same(a: tuple, b: tuple) -> bool:
    return all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6)) for x, y in zip(a, b))
