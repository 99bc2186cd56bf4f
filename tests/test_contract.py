"""The driver's contract: queries and their SQL agree on names and rows."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from toolweave import queries as own

SF = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("hidden", [("toolweave.llm",), ("corpus_pipeline",), ("toolweave.llm", "corpus_pipeline")])
def test_the_rest_works_without_the_text_queries(monkeypatch, hidden):
    """As if the folder, the pipeline or both were deleted."""
    for name in [m for m in sys.modules if m.startswith(hidden)]:
        monkeypatch.delitem(sys.modules, name)
    real = entry.find_spec
    monkeypatch.setattr(entry, "find_spec", lambda name: None if name in hidden else real(name))

    class Hide:
        @staticmethod
        def find_spec(name, path=None, target=None):
            if name.startswith(hidden):
                raise ModuleNotFoundError(name)

    monkeypatch.setattr(sys, "meta_path", [Hide, *sys.meta_path])
    assert set(own.QUERIES) <= set(entry.queries()) and set(own.ORACLES) <= set(entry.oracle_sql())
    assert "pipeline" not in entry.queries()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    df = own.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr(tuple(_plain(r[c]) for c in names)) for r in df.collect())
    made = con.execute(own.ORACLES[name])
    columns = [d[0] for d in made.description]
    assert sorted(columns) == names
    want = sorted(repr(tuple(_plain(r[columns.index(c)]) for c in names)) for r in made.fetchall())
    assert got == want
