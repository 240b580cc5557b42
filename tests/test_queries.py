"""Every registered query of the library runs on the smallest tables and agrees with its SQL, if it has any."""

import glob
import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

from deltaspan import registry  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canonical(rows, order):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if (sql := registry.oracle_sql().get(name)) is None:
        assert len(df.columns) == len(set(df.columns))
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    place = lambda c: sorted(range(len(c)), key=lambda i: c[i])
    assert canonical(rows, place(df.columns)) == canonical(want.fetchall(), place(want.columns))
