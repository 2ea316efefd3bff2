"""Every registered query runs over the smallest tables, and gives what its SQL gives."""

import importlib
from pathlib import Path

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
graph_queries = importlib.import_module("loomgraph.queries")


def rows(frame):
    shown = lambda x: None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted((tuple(shown(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(graph_queries.queries()))
def test_query(spark, tables, name):
    got = graph_queries.queries()[name](spark, SF).toPandas()
    sql = graph_queries.oracle_sql().get(name)
    if sql is not None:
        want = tables.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
