"""Every registered query over the smallest tables; those with SQL against DuckDB."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = [k for k in entry.queries() if entry.queries()[k].__module__.split(".")[1] != "llm"]
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


def rows(columns, values):
    at = sorted(range(len(columns)), key=columns.__getitem__)
    norm = lambda v: None if v is None or v != v else tuple(v) if isinstance(v, list) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([norm(r[i]) for i in at]) for r in values)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = df.collect()
    if name in entry.oracle_sql():
        want = duck.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, [list(r) for r in got]) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
