import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def _cell(x):
    if x is None or x != x:
        return "none"
    if isinstance(x, float) or hasattr(x, "__float__") and not isinstance(x, (bool, str)):
        return f"{float(x):.6g}"
    return str(x)


def _norm(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(_cell(x) for x in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.core.queries()))
def test_query(spark, duck, name):
    got = entry.core.queries()[name](spark, DATA).toPandas()
    sql = entry.core.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _norm(got) == _norm(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
