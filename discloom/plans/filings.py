"""Queries on markup written from tables, so that SQL knows what must come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from discloom.operators import documents as D, evidence as EV, points as PT
from discloom.plans.registry import Tables, query

# Every line of an order with its place; lines alike in all of these are interchangeable.
_LINES = "n as (select l_orderkey as doc, l_partkey as part, l_returnflag as flag, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) as i from lineitem)"


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _documents(t: Tables, head: Column, each: Column, tail: Column) -> DataFrame:
    """doc, html: an order's markup; `each` reads a line's i, part and flag."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    lines = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.row_number().over(order).alias("i"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", each.alias("c")))), lambda x: x["c"]), "")
    return lines.groupBy("doc").agg(body.alias("body")).select("doc", F.concat(head, "body", tail).alias("html"))


@query(
    "html_status",
    """select o_orderkey as doc, ['SUCCESS', 'RECOVERED', 'RECOVERED', 'FAILED', 'FAILED', 'SUCCESS', 'RECOVERED'][o_orderkey % 7 + 1] as status,
 ['', 'XML_RECOVERED', 'XML_TOLERANT_RECOVERY', 'XML_LOAD_FAILED', 'EMPTY_SOURCE', '', 'XML_RECOVERED'][o_orderkey % 7 + 1] as issues from orders""",
)
def html_status(t: Tables) -> DataFrame:
    """Sound, repairable, tolerantly readable, hopeless and empty documents, by order."""
    key, inner = F.col("o_orderkey"), _text("<p>", F.col("o_orderkey"), "</p>")
    kinds = [
        _text("<DOCUMENT>", inner, "</DOCUMENT>"), _text("<DOCUMENT>", inner, " R & D 3 < 4</DOCUMENT>"), _text("<DOCUMENT><p>", key, "</DOCUMENT>"), _text("plain ", key), F.lit(""),
        _text("<html><body><p>", key, " & <p>open</body>"), _text("<DOCUMENT>", inner, " see <the note below></DOCUMENT>"),
    ]
    html = F.element_at(F.array(*kinds), (key % 7 + 1).cast("int"))
    found = D.document_status(t.orders.select(key, html.alias("html")), "o_orderkey", "html", None)
    return found.withColumn("issues", F.array_join("issues", ","))


def _sectioned(t: Tables) -> DataFrame:
    """A section for each order and one within it for each line; paragraphs with a marker and a styled middle."""
    part = _text("<SECTION-2><TITLE>", F.col("i"), ". part ", F.col("part"), "</TITLE><P>(", F.col("i"), ") flag <B>", F.col("flag"), "</B> of part</P><P>plain ", F.col("part"), "</P></SECTION-2>")
    return _documents(t, F.lit("<DOCUMENT><SECTION-1><TITLE>I. order</TITLE><P>opening</P>"), part, F.lit("</SECTION-1></DOCUMENT>"))


@query("html_sections", f"""with {_LINES} select distinct doc, 0 as section, -1 as parent, 1 as level, 'EXPLICIT' as boundary, 'I. order' as title, 'I. order' as path, 1 as blocks from n
 union all select doc, i, 0, 2, 'EXPLICIT', i || '. part ' || part, 'I. order > ' || i || '. part ' || part, 2 from n""")
def html_sections(t: Tables) -> DataFrame:
    return D.section_rows(_sectioned(t), "doc", "html", True).withColumn("path", F.array_join("path", " > "))


@query("html_blocks", f"""with {_LINES} select distinct doc, 0 as section, 0 as block, 'P' as type, 'opening' as text from n
 union all select doc, i, 0, 'P', '(' || i || ') flag ' || flag || ' of part' from n union all select doc, i, 1, 'P', 'plain ' || part from n""")
def html_blocks(t: Tables) -> DataFrame:
    return D.block_rows(_sectioned(t), "doc", "html", True)


@query("html_paragraphs", f"""with {_LINES} select distinct doc, 0 as section, 0 as block, null as marker, 'opening' as text, 1 as fragments from n
 union all select doc, i, 0, '(' || i || ')', '(' || i || ') flag ' || flag || ' of part', 3 from n union all select doc, i, 1, null, 'plain ' || part, 1 from n""")
def html_paragraphs(t: Tables) -> DataFrame:
    return D.paragraph_rows(_sectioned(t), "doc", "html", True).withColumn("fragments", F.size("fragments"))


def _reported(t: Tables) -> DataFrame:
    """Exchange HTML without end tags of rows, cells and paragraphs: a heading, texts, a unit, a table and a note."""
    head = "<html><body><h2>실적</h2><p>본문 첫째<p>본문 첫째<p>(단위 : 원)<table><thead><tr><th>품목<th>구분</thead><tbody>"
    row = _text("<tr><td>", F.col("part"), "<td>", F.col("flag"))
    return _documents(t, F.lit(head), row, F.lit("</tbody></table><p>※ 주석 하나<p>끝맺음</body></html>"))


_TABLE = f"""{_LINES}, d as (select doc, string_agg('품목: ' || part || ', 구분: ' || flag, chr(10) order by i) as body, string_agg(part || '|' || flag, ';' order by i) as cells from n group by 1)"""


@query("html_evidence", f"""with {_TABLE} select doc, 0 as section, 0 as ordinal, 'TEXT' as kind, null as table_type, 'BODY' as role, '본문 첫째' as text, '실적' as path, null as title, '' as units, '' as notes, null as cells from d
 union all select doc, 0, 1, 'TABLE', 'R_TABLE', null, null, '실적', '실적', '(단위 : 원)', '※ 주석 하나', cells from d union all select doc, 0, 2, 'TEXT', null, 'BODY', '끝맺음', '실적', null, '', '', null from d""")
def html_evidence(t: Tables) -> DataFrame:
    """A repeated text counts once; unit and note go to the table between them."""
    rows = EV.evidence_rows(_reported(t), "doc", "html", None)
    cells = F.when(F.col("kind") == "TABLE", F.array_join(F.transform("records", lambda r: F.array_join(r["values"], "|")), ";"))
    return rows.select("doc", "section", "ordinal", "kind", "table_type", "role", "text", F.array_join("heading_path", " > ").alias("path"), "title", F.array_join("units", ",").alias("units"), F.array_join("notes", ",").alias("notes"), cells.alias("cells"))


_POINT_HEAD = "'company: ' || c_name || chr(10) || 'report: ' || o_orderpriority || chr(10) || 'section: 실적' || chr(10) || chr(10)"


@query("html_points", f"""with {_TABLE}, h as (select o_orderkey as doc, {_POINT_HEAD} as head from orders join customer on o_custkey = c_custkey), p as (
  select doc, 0 as ordinal, 'TEXT' as point_kind, '본문 첫째' as body from d union all select doc, 1, 'R_TABLE', body from d union all select doc, 2, 'TEXT', '끝맺음' from d)
 select p.doc, p.doc || ':0:' || ordinal as evidence_id, point_kind, null::int as chunk_index, null::int as chunk_count, head || body as contextual_text, sha256(head || body) as text_hash from p join h on p.doc = h.doc""")
def html_points(t: Tables) -> DataFrame:
    """Points with ids by name (the ids themselves are held against the uuid module in the tests)."""
    named = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc"), F.col("c_name").alias("corp_name"), F.col("o_orderpriority").alias("report_name"))
    return PT.build_points(EV.evidence_rows(_reported(t), "doc", "html", None), named).drop("point_id")
