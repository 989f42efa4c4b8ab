"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry


def test_registry():
    known, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(known) and len(known) > 80
    assert all(callable(q) for q in known.values())


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="needs the tables")
def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["c_mktsegment", "c_custkey", "status", "value", "input_count", "rank"] and found.count() > 0


@pytest.mark.skipif(not os.path.isdir(entry.SMOKE_DIR), reason="needs the tables")
def test_filters_reach_the_scan(spark, capsys):
    entry.queries()["filter_match_any"](spark, entry.SMOKE_DIR).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(o_orderstatus), In(o_orderpriority" in plan or "EqualTo(o_orderstatus,F)" in plan
    assert "o_totalprice" not in plan
