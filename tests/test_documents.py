"""Markup parsing on literal fixtures."""

import io
import zipfile

import pytest

from discloom.operators import documents as D
from discloom.sources import readers
from pyspark.sql import functions as F


def table(html):
    root, *_ = D.load(html, strict=False)
    g, status, tops = D.grid(root.find("table")[0])
    kind, tops = D.table_type(g, tops)
    return g, status, kind, tops


def test_spans_and_header_paths():
    g, status, kind, tops = table("<table><thead><tr><th rowspan=2>구분</th><th colspan=2>금액</th></tr><tr><th>당기</th><th>전기</th></tr></thead><tbody><tr><td rowspan=2>매출</td><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr><tr><td>합계</td><td>4</td><td>6</td></tr></tbody></table>")
    assert (status, kind, tops) == ("SUCCESS", "R_TABLE", 2)
    assert D.headers_of(g, tops) == [["구분"], ["금액", "당기"], ["금액", "전기"]]
    found = D.records(g, tops)
    assert [(r["row_type"], r["row_context"], r["values"]) for r in found] == [("DATA", [], ["매출", "1", "2"]), ("DATA", ["매출"], ["매출", "3", "4"]), ("TOTAL", [], ["합계", "4", "6"])]


def test_overlap_is_partial_and_bad_spans_are_one():
    _, status, *_ = table("<table><tr><td>a</td><td rowspan=2>b</td></tr><tr><td colspan=2>c</td></tr></table>")
    assert status == "PARTIAL"
    g, status, *_ = table("<table><tr><td colspan='x'>a</td><td rowspan=0>b</td></tr></table>")
    assert status == "SUCCESS" and len(g) == 1 and len(g[0]) == 2


@pytest.mark.parametrize("html,kind", [
    ("<table><tr><td>대표이사</td><td>홍길동 1</td></tr><tr><td>본점</td><td>서울 2</td></tr></table>", "KV_TABLE"),
    ("<table><tr><td>연도</td><td>금액</td></tr><tr><td>2023</td><td>1</td></tr><tr><td>2024</td><td>2</td></tr></table>", "R_TABLE"),
    ("<table><tr><td>하나</td></tr></table>", "LAYOUT"), ("<table><tr><td></td><td> </td></tr></table>", "LAYOUT"),
    ("<table><tr><td>x 1</td><td>y</td></tr></table>", "UNKNOWN"),
])
def test_types(html, kind):
    assert table(html)[2] == kind


def test_kv_fields():
    g, *_ = table("<table><tr><td>대표이사</td><td>홍길동 1</td><td>설립</td><td>1999</td></tr></table>")
    assert [(f["key_paths"], f["raw_value"]) for f in D.kv_fields(g)] == [([["대표이사"]], "홍길동 1"), ([["설립"]], "1999")]


def test_loading_degrees():
    assert D.load("<a><b>x</b></a>")[1] == "SUCCESS"
    assert D.load("<a>x & y</a>")[1:] == ("RECOVERED", ["XML_RECOVERED"])
    assert D.load("<document><b>x</document>")[1:] == ("RECOVERED", ["XML_TOLERANT_RECOVERY"])
    assert D.load("<a><b>x</a>")[1:] == ("FAILED", ["XML_LOAD_FAILED"])
    assert D.load("<a>see <the note> below</a>", None)[0].text() == "see <the note> below"
    assert D.load("<HTML><p>x & <p>y", None)[1:] == ("SUCCESS", [])
    assert D.load("plain")[1] == "FAILED" and D.load(None)[1] == "FAILED"
    assert D.decode("한글".encode("euc-kr")) == "한글"
    assert D.decode("한글".encode("euc-kr") + b"\xff") == "한글�"


def test_omitted_end_tags():
    for html in ("<table><tr><td>a<td>b<tr><td>c<td>d</table>", "<table><tr><td><b>a<td>b<tr><th><i>c<td>d</table>"):
        g, *_ = table(html)
        assert [[c.text for c in row] for row in g] == [["a", "b"], ["c", "d"]]
    root, *_ = D.load("<ul><li>x<li><b>y</ul><p>1<p>2", False)
    assert [n.text() for n in root.find("li", "p")] == ["x", "y", "1", "2"]


def test_sections_by_elements_headings_and_numbers():
    xml = "<doc><section-1><title>I. 개요</title><p>앞</p><section-2><title>1. 상세</title><p>안</p></section-2></section-1><section-1><title>II. 끝</title></section-1></doc>"
    found = D.sections(D.load(xml)[0])
    assert [(s["title"], s["level"], s["parent"], s["path"]) for s in found] == [("I. 개요", 1, -1, ["I. 개요"]), ("1. 상세", 2, 0, ["I. 개요", "1. 상세"]), ("II. 끝", 1, -1, ["II. 끝"])]
    html = "<h1>A</h1><p>x</p><h2>B</h2><p>y</p><h1>C</h1>"
    assert [(s["title"], s["parent"], len(s["blocks"])) for s in D.sections(D.load(html, False)[0])] == [("A", -1, 1), ("B", 0, 1), ("C", -1, 0)]
    numbered = "<p>1. 하나</p><p>글</p><p>2. 둘</p><p>가. 홀로</p>"
    assert [s["title"] for s in D.sections(D.load(numbered, False)[0])] == ["1. 하나", "2. 둘"]


def test_rows_of_documents(spark):
    docs = spark.createDataFrame([(1, "<p><b>1. 제목</b></p><p>본문 <i>강조</i></p><table><tr><td>연도</td><td>값</td></tr><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>"), (2, None), (3, "")], "id long, html string")
    assert [(r.doc, r.status) for r in D.document_status(docs, "id", "html").orderBy("doc").collect()] == [(1, "SUCCESS"), (2, "FAILED"), (3, "FAILED")]
    assert [(r.title, r.blocks) for r in D.section_rows(docs, "id", "html").collect()] == [("1. 제목", 2)]
    assert [(r.type, r.text) for r in D.block_rows(docs, "id", "html").orderBy("block").collect()] == [("P", "본문 강조"), ("TABLE", "연도값1234")]
    assert D.paragraph_rows(docs, "id", "html").first().fragments == ["본문", "강조"]
    assert D.table_rows(docs, "id", "html").first().type == "R_TABLE"
    fix = spark.createDataFrame([(1, "<doc><correction>1. 정정일자 : 2024-01-02 2. 정정사유 : 오기</correction></doc>"), (2, "<doc><p>x</p></doc>")], "id long, html string")
    got = {r.doc: r for r in D.correction_rows(fix, "id", "html", True).collect()}
    assert (got[1].status, got[1].correction_date, got[1].reason) == ("FOUND", "2024-01-02", "오기") and "MISSING_ORIGINAL_SUBMISSION_DATE" in got[1].issues
    assert got[2].status == "NOT_FOUND"


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "1", "v": 1}\n\nnot json\n[1]\n{"k": "1", "v": 2}\n{"v": 3}\n')
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("k string, v int")
    assert sorted(r.v for r in readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [1, 2, 3]
    assert [tuple(r) for r in readers.read_keyed_jsonl(spark, str(tmp_path / "a.jsonl"), schema, "k").collect()] == [("1", 2)]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema, strict=True).collect()
    assert readers.read_jsonl(spark, str(tmp_path / "none"), schema, missing_ok=True).count() == 0
    head = ",".join(readers.COMPANY_FIELDS)
    (tmp_path / "c.csv").write_text(f'﻿{head}\n001,005930,A, ,KOSPI,x,y,1975-06-11,"1,234"\n', encoding="utf-8")
    row = readers.read_companies(spark, str(tmp_path / "c.csv"), 1).first()
    assert (row.corp_code, row.corp_eng_name, row.market_cap, row.listing_date.year) == ("001", None, 1234, 1975)
    with pytest.raises(ValueError):
        readers.read_companies(spark, str(tmp_path / "c.csv"), 70)


def test_last_line_of_several_files_wins(spark, tmp_path):
    from pyspark.sql.types import StructType

    for name, lines in (("a", 3), ("b", 400), ("c", 2)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"k": "{k % 7}", "v": "{name}{k}", "w": {k}}}\n' for k in range(lines)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = readers.read_keyed_jsonl(spark, str(tmp_path), StructType.fromDDL("k string, v string, w int"), "k").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.k: r.v for r in got} == {str(k): "c" + str(k) if k < 2 else f"b{max(x for x in range(400) if x % 7 == k)}" for k in range(7)}


def test_workbook(spark, tmp_path):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>주식</t></r><r><t>분할</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>tags</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>a | b|a</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(out.getvalue())
    path = str(tmp_path / "b.xlsx")
    assert [tuple(r) for r in readers.read_categories(spark, path).collect()] == [(2, "주식분할", "a | b|a")]
    assert [tuple(r) for r in readers.read_knowledge(spark, path, ["name", "tags"], ["tags"]).collect()] == [("S", "주식분할", ["a", "b"])]


def test_source_files(spark, tmp_path):
    for name in ("20240101000001/20240101000001.xml", "20240101000001/a.html", "20240101000001/x.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("<a/>")
    got = readers.source_files(spark, str(tmp_path)).orderBy("position").select("name", F.col("position").cast("int")).collect()
    assert [tuple(r) for r in got] == [("20240101000001.xml", 0), ("a.html", 1)]
