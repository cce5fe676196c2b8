"""Every registered catalog query against its SQL, on the smallest tables."""

import glob
import os

import pytest

from lumaloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows, columns):
    def cell(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.8g}" if isinstance(v, (int, float)) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    if name in registry.ORACLES:
        cursor = duck.execute(registry.ORACLES[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(cursor.fetchall(), columns)
