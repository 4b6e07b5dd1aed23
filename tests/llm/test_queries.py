"""Registered queries of the subpackage over the smallest tables."""

import os

import pytest

from lifeweave.llm.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    got = df.collect()
    assert got
    if name in SQL:
        import duckdb

        c = duckdb.connect()
        for f in os.listdir(DATA):
            c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
        want = c.execute(SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(repr(tuple(r[k] for k in columns)) for r in got) == sorted(repr(x) for x in want.fetchall())
