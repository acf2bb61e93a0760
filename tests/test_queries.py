import os

import pytest

import __spark_entry__ as entry
from gridmill.jobs import registry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return con


def plain(v):
    """A value in a form that both engines give alike: numbers to six digits, structs as lists."""
    if isinstance(v, bool | None | str | bytes):
        return str(v)
    if isinstance(v, list | tuple):
        return [*map(plain, v)]
    if isinstance(v, dict):
        return [*map(plain, v.values())]
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, con, name):
    rows, want = registry.queries()[name](spark, sf), con.execute(registry.oracle_sql()[name])
    columns = sorted(rows.columns)
    at = [x[0] for x in want.description]
    assert columns == sorted(at)
    theirs = sorted(repr([plain(r[at.index(c)]) for c in columns]) for r in want.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in rows.collect()) == theirs
    assert theirs


@pytest.mark.parametrize("name", sorted({*registry.queries()} - {*registry.oracle_sql()}))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert {*registry.queries()} <= {*entry.queries()} and {*registry.oracle_sql()} <= {*entry.oracle_sql()}
