"""Each query that SQL can express gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from threadloom.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def _same(a, b):
    return math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    if name not in ORACLES:
        assert got
        return
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    want = sorted(con.sql(ORACLES[name]).select(*(f'"{c}"' for c in cols)).fetchall(), key=str)
    assert len(got) == len(want)
    assert all(_same(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))
