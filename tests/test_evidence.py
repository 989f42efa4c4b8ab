"""From markup to evidence, points and events."""

import pytest

from discloom.operators import disclosure_events as DE, evidence as EV, points as PT, projections as PR
from pyspark.sql import functions as F

HTML = """<h1>사업 개요</h1><p>본문이다.</p><p>본문이다.</p><p>[요약표]</p><p>(단위: 원)</p>
<table><tr><td>연도</td><td>금액</td></tr><tr><td>2023</td><td>10</td></tr><tr><td>합계</td><td>30</td></tr></table><p>주1) 잠정</p>
<table><tr><td>연도</td><td>금액</td></tr><tr><td>2023</td><td>10</td></tr><tr><td>합계</td><td>30</td></tr></table>
<h2>결정</h2><table><tr><td>이사회결의일</td><td>2024년 3월 5일</td></tr><tr><td>발행주식수</td><td>1,000</td></tr></table>"""


@pytest.fixture(scope="module")
def evidence(spark):
    return EV.evidence_rows(spark.createDataFrame([(1, HTML), (2, None)], "id long, html string"), "id", "html").cache()


def test_evidence(evidence):
    got = evidence.orderBy("section", "ordinal").collect()
    assert [(r.section, r.ordinal, r.kind, r.table_type) for r in got] == [(0, 0, "TEXT", None), (0, 1, "TABLE", "R_TABLE"), (1, 0, "TABLE", "KV_TABLE")]
    t = got[1]
    assert (t.title, t.units, t.captions, t.notes) == ("[요약표]", ["(단위: 원)"], ["[요약표]"], ["주1) 잠정"])
    assert [r["row_type"] for r in t.records] == ["DATA", "TOTAL"] and got[2].heading_path == ["사업 개요", "결정"]


def test_points(spark, evidence):
    docs = spark.createDataFrame([(1, "가나", "보고서")], "doc long, corp_name string, report_name string")
    points = PT.build_points(evidence, docs)
    rows = {r.evidence_id: r for r in points.collect()}
    assert set(rows) == {"1:0:0", "1:0:1", "1:1:0"} and "연도: 2023, 금액: 10" in rows["1:0:1"].contextual_text and rows["1:0:1"].chunk_index is None
    small = [r for r in PT.build_points(evidence, docs, row_limit=8).collect() if r.evidence_id == "1:0:1"]
    assert sorted(r.chunk_index for r in small) == [0, 1] and len({r.point_id for r in small}) == 2
    calls = PT.embed_once(points.unionAll(points), lambda texts: [[float(len(t))] for t in texts]).collect()
    assert len(calls) == 6 and all(r.vector == [float(len(r.contextual_text))] for r in calls)


def test_events(spark, evidence):
    rows = [(1, "exchange", "유상증자결정", True), (2, "major", "유상증자결정", True), (3, "periodic", "x", True), (4, "major", "x", False)]
    docs = spark.createDataFrame(rows, "doc long, doc_group string, subtype string, is_latest boolean").selectExpr("*", "'자본·증권발행' as event_type", "'20240401' as receipt_date", "case when doc = 1 then '가나' end as company")
    got = {r.doc: r for r in DE.build_events(evidence, docs).collect()}
    assert set(got) == {1, 2} and got[1].family == "capital_securities" and got[1].status == "SUCCESS"
    assert got[1].content.startswith("가나의 유상증자결정 공시 사건\n\n이벤트 분류: 자본·증권발행\n\n핵심 사실\n- ") and "\n\n보충 설명\n- " in got[1].content
    assert (str(got[2].event_date), got[2].issue, got[2].status) == ("2024-04-01", "EVENT_DATE_FALLBACK_TO_RECEIPT_DATE", "ERROR")
    assert got[2].content.startswith("발행회사의 ") and got[2].content.endswith("공시 본문에서 구조화된 핵심 사실을 추출하지 못했습니다.")


def test_projections(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    heads = F.array(F.array(F.lit("a")), F.array(F.lit("a")), F.array(F.lit("")))
    assert one(PR.keyed_values(heads, F.array(*map(F.lit, "xyz")))) == {"a": "x", "a [2]": "y", "column_2": "z"}
    with pytest.raises(Exception, match="record width"):
        one(PR.keyed_values(heads, F.array(F.lit("x"))))
    assert one(PR.named_values(F.lit('{"a": {"id": "x"}, "b": [{"id": "y"}, {"id": "x"}]}'), "id")) == ["x", "y"]
    assert one(PR.real_note(F.lit(" 없음 "))) is None and one(PR.is_limitation(F.lit("자료가 부족합니다")))
    with pytest.raises(ValueError):
        PR.exact_fields({"a": True}, {"a": int})
    from pyspark.sql.types import StructType

    assert PR.forbidden_fields(StructType.fromDDL("a struct<b:array<struct<x:int>>>, x int"), ["x"]) == ["a.b.x", "x"]
    rows = spark.createDataFrame([(1, "d", "s", "e", 1), (1, "d", "s", "e", 2), (2, "d", None, "e", 1)], "k int, d string, s string, e string, p int")
    assert {r.k: len(r.source_references) for r in PR.references_or_nothing(rows, "k", "d", "s", "e", "p").collect()} == {1: 1, 2: 0}
    tree = spark.createDataFrame([(1, 0, -1, "ROOT"), (1, 1, 0, "HEADING"), (2, 0, -1, "ROOT")], "d int, s int, p int, b string")
    assert sorted(map(tuple, PR.kept_sections(tree, "d", "s", "p", "b").collect())) == [(1, 1, -1, "HEADING"), (2, 0, -1, "ROOT")]
    assert one(PR.citation(F.lit("가"), F.lit("나"), F.lit("2024-03-05").cast("date"), F.array(F.lit("a"), F.lit("b")))) == "가, 나 (2024-03-05), a > b"


def test_context_is_checked_against_metadata(spark):
    rows = spark.createDataFrame([("company: 가\nreport: 나\n\nbody", "가")], "t string, c string")
    assert rows.select(PR.checked_context(F.col("t"), {"company": F.col("c")}).alias("x")).first().x.company == "가"
    with pytest.raises(Exception, match="company differs"):
        rows.select(PR.checked_context(F.col("t"), {"company": F.lit("다")})).collect()


def test_only_changed_documents_are_rebuilt(spark):
    from discloom.sources.readers import reusable

    before = spark.createDataFrame([(1, "h1", "v1"), (2, "h2", "v1"), (3, "h3", "v0")], "k int, h string, v string")
    now = spark.createDataFrame([(1, "h1", "v1"), (2, "hx", "v1"), (3, "h3", "v1"), (4, "h4", "v1")], "k int, h string, v string")
    assert sorted(r.k for r in reusable(before, now, ["k"], "h", "v").collect()) == [2, 3, 4]
