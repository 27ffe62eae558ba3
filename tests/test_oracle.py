"""Every query with SQL against DuckDB, and every query without it for rows."""

import pytest

from graphloom import catalog

from . import oracle

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        oracle.compare(spark, con, SMALL, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, SMALL).count() > 0
