"""Numeric cells and statistics against plain restatements, reason by reason."""

import re
from decimal import Decimal

import pytest

from discloom.functions import numeric, text as X
from discloom.operators import statistics as S
from pyspark.sql import functions as F

CELLS = ["1,200", "12.5%", "(300)", "-", "–", "", "  ", None, "( )", "(-5)", "(300) 원", "1,2,3", "12,34", "2025.02.03", "1e3", "12345,678", "+7", "-8.25 kg", "5 ea 2", "3.", "()", "abc", "　42　", "(1,000.5)", "7 %", "1,2000", "(", ")", "0"]


def plain(cell):
    blanks = numeric.BLANKS
    if cell is None or not cell.strip(blanks):
        return None, None, True, False
    t = cell.strip(blanks)
    wrapped = len(t) >= 2 and t[0] == "(" and t[-1] == ")"
    body = t[1:-1].strip(blanks) if wrapped else t
    if not body or body in numeric.DASHES:
        return None, None, True, False
    m = re.match(r"[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?", body)
    rest = body[m.end() :].strip(blanks) if m else ""
    if not m or re.search(r"[0-9]", rest) or rest[:1] in set("+-.,") - {""}:
        return None, None, False, True
    v = Decimal(m[0].replace(",", ""))
    return float(-abs(v) if wrapped else v), rest or None, False, False


def test_cells(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(CELLS)], "i int, c string")
    got = rows.select("i", numeric.parse_numeric_cell(F.col("c")).alias("p")).orderBy("i").collect()
    for r in got:
        value = None if r.p.value is None else float(r.p.value)
        assert (value, r.p.unit, r.p.is_missing, r.p.is_invalid) == plain(CELLS[r.i]), CELLS[r.i]


CASES = [
    ("sum", ["1", "2", "-"], "SUCCESS", None, 3.0, 2), ("sum", ["1", "x"], "INVALID_INPUT", "numeric_parsing", None, 0), ("mean", ["1 kg", "2 t"], "INVALID_INPUT", "unit_check", None, 0),
    ("sum", ["-", ""], "INVALID_INPUT", "numeric_parsing", None, 0), ("mode", ["1", "1", "2"], "SUCCESS", None, 1.0, 3), ("mode", ["1", "1", "2", "2"], "INVALID_INPUT", "calculation", None, 0),
    ("stdev", ["5"], "INVALID_INPUT", "calculation", None, 0), ("median", ["1", "2", "3", "10"], "SUCCESS", None, 2.5, 4), ("max", ["(5)", "-1"], "SUCCESS", None, -1.0, 2),
]


@pytest.mark.parametrize("op,cells,status,stage,value,n", CASES)
def test_statistics(spark, op, cells, status, stage, value, n):
    r = S.column_statistic(spark.createDataFrame([(1, c) for c in cells], "k int, c string"), ["k"], "c", op).first()
    assert (r.status, r.failure_stage, r.value, r.input_count) == (status, stage, value, n)


def test_missing_cell_of_a_selected_row_fails(spark):
    rows = spark.createDataFrame([(1, "4", True), (1, "-", True)], "k int, c string, s boolean")
    assert S.column_statistic(rows, ["k"], "c", "sum", selected=F.col("s")).first().failure_stage == "numeric_parsing"
    assert S.column_statistic(rows, ["k"], "c", "sum").first().value == 4


def test_combinations(spark):
    rows = spark.createDataFrame([(100.0, 121.0, 2, "KRW", "KRW"), (0.0, 5.0, 1, None, None), (1.0, 2.0, 1, None, "KRW"), (-1.0, 2.0, 1, None, None)], "a double, b double, n int, u string, v string")
    run = lambda op: [r[0] for r in rows.select(S.combine(op, F.col("a"), F.col("b"), F.col("n"), F.col("u"), F.col("v"))).collect()]
    cagr = run("cagr")
    assert abs(cagr[0].value - 10) < 1e-9 and cagr[0].unit == "%" and [r.failure_stage for r in cagr] == [None, "calculation", "unit_check", "calculation"]
    assert [r.failure_stage for r in run("percent_change")] == [None, "calculation", "unit_check", None]
    assert run("ratio")[1].value == 0 and run("difference")[0].value == -21


def test_ties_keep_input_order_both_ways(spark):
    rows = spark.createDataFrame([(1, 5, 0), (1, 7, 1), (1, 5, 2)], "k int, v int, p int")
    for down, want in ((True, {1: 1, 0: 2, 2: 3}), (False, {0: 1, 2: 2, 1: 3})):
        assert {r.p: r["rank"] for r in S.ordering(rows, ["k"], "v", "p", down).collect()} == want


@pytest.mark.parametrize("chunks,reason", [
    ([(0, 2, 0, 9, 10), (1, 2, 10, 14, 5)], None), ([(0, 1, 0, 9, 10)], "chunk_count"), ([(0, 2, 0, 9, 10)], "missing_index"), ([(0, 2, 0, 9, 10), (0, 2, 10, 14, 5)], "repeated_index"),
    ([(0, 2, 1, 9, 9), (1, 2, 10, 14, 5)], "row_start"), ([(0, 2, 0, 9, 9), (1, 2, 10, 14, 5)], "row_range"), ([(0, 2, 0, 9, 10), (1, 2, 11, 14, 4)], "contiguity"), ([(0, 2, 0, 9, 10), (2, 2, 10, 14, 5)], "index_range"),
])
def test_completeness(spark, chunks, reason):
    rows = spark.createDataFrame([("t", *c) for c in chunks], "t string, i int, n int, s int, e int, r int")
    assert S.completeness(rows, "t", "i", "n", "s", "e", "r").first().reason == reason


def test_row_selection_is_all_or_nothing(spark):
    rows = spark.createDataFrame([("a ", 1), ("b", 2), ("b", 3)], "l string, v int")
    ask = lambda *w: [r.v for r in S.select_rows(rows, "l", spark.createDataFrame(list(enumerate(w)), "p int, w string"), "w", "p").orderBy("position").collect()]
    assert ask("a") == [1] and ask("a", "b") == [] and ask("z") == []


def test_texts(spark):
    import uuid

    one = lambda c: spark.range(1).select(c).first()[0]
    names = ["", "d1:src0:s1", "한글", "x" * 100]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(X.uuid5(uuid.NAMESPACE_URL.hex, F.col("n"))).collect()
    assert [r[0] for r in rows] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert one(X.find_date(F.lit("결의일 2024년 3월 5일"))).isoformat() == "2024-03-05" and one(X.find_date(F.lit("20240230"))) is None
    assert one(X.clean_report_name(F.lit("[기재정정]주요사항보고서(유상증자결정)"))) == "유상증자결정"
    assert one(X.path_text(F.array(*map(F.lit, ["a", " a", "", "b", "a"])))) == "a > b > a"
    assert one(X.text_class(F.lit("(단위: 원)"))) == "UNIT" and one(X.text_class(F.lit("1. 개요"))) == "HEADING" and one(X.text_class(F.lit("그냥 글"))) == "BODY"
    assert [str(x) for x in one(X.period_bounds(F.lit("2024-02 ~ 2024")))] == ["2024-02-01", "2024-12-31"]
    assert one(X.parent_id(X.disclosure_id(F.lit("evidence:20240101000001:src0:s3:e2")), 3)) == "d20240101000001:src0:s3"
    assert one(X.repair_markup(F.lit("a & b &amp; <3 <b>"))) == "a &amp; b &amp; &lt;3 <b>"
