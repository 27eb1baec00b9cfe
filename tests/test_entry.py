"""Registered queries against their SQL, in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def test_registry():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    names = sorted(df.columns)
    assert sorted(duck.sql(SQL[name]).columns) == names
    want = duck.sql("select " + ", ".join(f'"{n}"' for n in names) + f" from ({SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, want))


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].asDict().keys() == {"key", "depth", "n", "own_error", "geometric_error"}
