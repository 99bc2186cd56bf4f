"""Queries of toolweave.llm against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from toolweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    made = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in made.description]
    want = sorted(repr(tuple(r[columns.index(c)] for c in names)) for r in made.fetchall())
    assert sorted(columns) == names and got == want
