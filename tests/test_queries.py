"""The core queries against their SQL, over the smallest tables."""

import os

import pytest

from docweave.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def plain(value):
    return round(float(value), 6) if not isinstance(value, (str, bool, type(None))) and hasattr(value, "__float__") else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    cur = sql.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(map(plain, r))) for r in cur.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want
