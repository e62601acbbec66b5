"""The driver's contract: names, columns and results of queries against their SQL, at the smallest size."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"])
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    assert got == sorted((tuple(r) for r in want.select(*cols).fetchall()), key=str)
