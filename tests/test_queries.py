import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pentad.plans import queries as library

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([v[i] for i in order]) for v in values)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_against_sql(spark, con, name):
    df = library.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in library.SQL:
        want = con.sql(library.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows(df.columns, got) == rows(want.columns, want.fetchall())
