"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from graphqa.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    sql = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(map(str, sql.fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == want
