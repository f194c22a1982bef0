"""The registered queries against their SQL at the smallest size."""

import os

import duckdb
import pytest

from orrery.plans import CORE_ORACLE, CORE_QUERIES

DATA = "/root/testdata/sf0.001"
SOME = [n for i, n in enumerate(sorted(CORE_ORACLE)) if i % 3 == 0]


def test_every_query_has_sql():
    assert set(CORE_QUERIES) == set(CORE_ORACLE)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = CORE_QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({CORE_ORACLE[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(map(repr, [tuple(r) for r in got.select(*cols).collect()]))
