"""Every query of the reference's own operators that has SQL gives the rows that DuckDB gives, over the smallest tables."""

import math
import os

import duckdb
import pytest

from discloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the tables")


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "as_tuple") else str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    base = duckdb.connect()
    for name in os.listdir(SMALL):
        path = f"{SMALL}/{name}" if os.path.isfile(f"{SMALL}/{name}") else f"{SMALL}/{name}/*.parquet"
        base.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    return base


@needs_tables
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got = catalogue.QUERIES[name](spark, SMALL)
    want = db.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert _rows(got.columns, got.collect()) == _rows(columns, want.fetchall())
