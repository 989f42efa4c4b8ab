"""Queries do the whole of their tables: no ids are left out, no keys are cut."""

import os
import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
from discloom.operators import relational as R, search

SMALL = entry.SMOKE_DIR
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the tables")


def _by_sql(name):
    """Rows of the query's SQL, which has no filter of its own."""
    sql = entry.oracle_sql()[name]
    db = duckdb.connect()
    for table in os.listdir(SMALL):
        db.execute(f"create view {table.removesuffix('.parquet')} as select * from '{SMALL}/{table}'")
    return sorted(db.execute(sql).fetchall())


def _addressed(fact, text):
    tokens = {x for x in re.findall("[0-9A-Za-z가-힣]+", fact) if len(x) >= 2}
    return bool(tokens) and any(all(x in s for x in tokens) for s in re.split("[.!?\n]+", text))


@pytest.mark.parametrize("block, size", [(500, 4 << 20), (3, 0)])
def test_fact_coverage_asks_all_tokens_of_every_pair(spark, tmp_path, monkeypatch, block, size):
    monkeypatch.setattr(search, "FACT_BLOCK", block)
    monkeypatch.setattr(search, "FACT_BYTES", size)
    docs = [(1, "Alpha beta gamma delta. Zeta"), (7, "alpha beta gamma. delta!"), (20, "alphabet beta gamma"), (21, "x"), (40, ""), (41, "매출 2024\n이익 2025년")]
    facts = [(0, "alpha beta gamma delta"), (4, "Alpha, beta"), (5, "zeta"), (9, "1 2"), (12, "gamma delta"), (300, "beta beta gamma alpha"), (301, "매출 2024"), (302, "매출 2025"), (303, "Alpha beta")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(facts, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, entry.queries()["requested_fact_coverage"](spark, str(tmp_path)).collect()))
    assert got == sorted((d, i, _addressed(fact, text)) for d, text in docs for i, fact in facts)


@needs_tables
def test_fact_coverage_on_the_tables(spark):
    docs, facts = (duckdb.sql(f"select * from '{SMALL}/{x}.parquet'").fetchnumpy() for x in ("documents", "benchmark"))
    want = {(int(d), int(i), _addressed(fact, text)) for d, text in zip(docs["doc_id"], docs["text"]) for i, fact in zip(facts["item_id"], facts["text"])}
    got = entry.queries()["requested_fact_coverage"](spark, SMALL).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def _resolved(source, candidates):
    """The cascade in plain Python, over all candidates."""
    src, receipt, day, group, company, name, family = source
    if day is None:
        return src, "NOT_RESOLVED", None
    number = lambda x: re.fullmatch(r"\d{14}", x) is not None
    met = [c for c in candidates if c[1] == day and c[0] != receipt and (not (number(receipt) and number(c[0])) or c[0] < receipt)]
    grouped = [c for c in met if None in (group, c[2]) or group == c[2]]
    own = [c for c in grouped if company in (None, c[3])]
    exact, kin = ([c for c in own if None not in (v, c[k]) and v == c[k]] for k, v in ((4, name), (5, family)))
    for rows, code in ((met, "DATE_NOT_FOUND"), (grouped, "GROUP_MISMATCH"), (own, "COMPANY_MISMATCH")):
        if not rows:
            return src, code, None
    for rows, code in ((exact, "EXACT"), (kin, "DOCUMENT_FAMILY_RECOVERED"), (own, "UNIQUE_CANDIDATE_RECOVERED")):
        if rows:
            return (src, code, rows[0][0]) if len(rows) == 1 else (src, "AMBIGUOUS", None)


def test_resolution_from_buckets_is_that_of_all_pairs(spark):
    rnd = random.Random(7)
    one = lambda *x: rnd.choice(x)
    receipt = lambda: one(f"{rnd.randrange(12):014d}", f"{rnd.randrange(12):014d}", f"r{rnd.randrange(4)}")
    rest = lambda: (one("g", "h", None), one("A", "B", "C", None), one("n", "m", "o", None), one("f", "e", None))
    candidates = [(receipt(), f"d{rnd.randrange(40)}", *rest()) for _ in range(240)]
    sources = [(k, receipt(), one(*[f"d{x}" for x in range(42)], None), *rest()) for k in range(1500)]
    c = spark.createDataFrame(candidates, "receipt string, submitted string, doc_group string, company string, name string, family string")
    s = spark.createDataFrame(sources, "src long, receipt string, original_date string, doc_group string, company string, name string, family string")
    want = [_resolved(x, candidates) for x in sources]
    assert sorted(map(tuple, R.resolve_corrections(s, c).collect())) == want and len({x[1] for x in want}) == 8


@pytest.mark.parametrize("texts, loose, few", [(False, False, 50_000), (True, False, 0), (False, True, 0), (True, True, 50_000)])
def test_resolution_with_and_without_odd_receipts_and_groups(spark, monkeypatch, texts, loose, few):
    monkeypatch.setattr(R, "FEW_DAYS", few)
    rnd = random.Random(11)
    one = lambda *x: rnd.choice(x)
    number = lambda: f"{rnd.randrange(30):014d}"
    odd = lambda: one(number(), "r1", "r2", "r3", f"{number()}\n", "0" * 15)
    rest = lambda no_group: (one("g", "h", None) if no_group else one("g", "h"), one("A", "B", None), one("n", "m", None), one("f", "e", None))
    candidates = [(odd() if texts else number(), f"d{rnd.randrange(25)}", *rest(loose)) for _ in range(200)]
    sources = [(k, odd(), one(*[f"d{x}" for x in range(27)], None), *rest(True)) for k in range(900)]
    c = spark.createDataFrame(candidates, "receipt string, submitted string, doc_group string, company string, name string, family string")
    s = spark.createDataFrame(sources, "src long, receipt string, original_date string, doc_group string, company string, name string, family string")
    want = [_resolved(x, candidates) for x in sources]
    assert sorted(map(tuple, R.resolve_corrections(s, c).collect())) == want and len({x[1] for x in want}) == 8


def test_resolution_makes_no_rows_of_a_source_and_gathers_none(spark):
    c = spark.createDataFrame([("00000000000001", "d", "g", "A", "n", "f")], "receipt string, submitted string, doc_group string, company string, name string, family string")
    s = spark.createDataFrame([(7, "00000000000002", "d", "g", "A", "n", "f")], "src long, receipt string, original_date string, doc_group string, company string, name string, family string")
    found = R.resolve_corrections(s, c)
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "aggregate [src" not in plan and "collect_list" not in plan and "dense_rank" not in plan
    assert found.collect() == [(7, "EXACT", "00000000000001")]


@needs_tables
def test_every_order_is_a_source_of_a_correction(spark):
    got = sorted(map(tuple, entry.queries()["correction_target_resolution"](spark, SMALL).collect()))
    assert got == _by_sql("correction_target_resolution")


@needs_tables
@pytest.mark.parametrize("name", ["record_projection", "answer_envelopes"])
def test_every_order_is_projected(spark, name):
    assert sorted(map(tuple, entry.queries()[name](spark, SMALL).collect())) == _by_sql(name)
