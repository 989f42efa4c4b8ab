"""Queries on whole chains: statistics of chunked tables, fragments, events, element paths, latest flags, values of descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from discloom.operators import disclosure_events as DE, documents as D, fragments as FR, profiling as P, relational as R, statistics as S
from discloom.plans.registry import Tables, query

_CHUNKED = "l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) as i, count(*) over (partition by l_orderkey) as n from lineitem)"


@query(
    "table_statistic_chain",
    f"""with {_CHUNKED}, c as (select *, l_orderkey % 11 = 0 as torn, l_orderkey % 7 <> 0 as cited, l_orderkey % 5 = 0 as asked, l_orderkey % 10 = 0 as doubled from l where n > 1),
 p as (select l_orderkey, bool_or(torn) as torn, bool_or(cited) as cited, bool_or(asked) as asked, bool_or(doubled) as doubled, count(*) as n,
  count(*) filter (where l_linenumber = 3 and i > 2 and l_orderkey % 13 = 0) as bad, count(distinct case when l_orderkey % 3 = 0 then l_returnflag end) as units, min(case when l_orderkey % 3 = 0 then l_returnflag end) as unit,
  sum(l_quantity::bigint) as total, sum(case when i <= 2 then l_quantity::bigint end) as two, count(distinct case when i <= 2 and l_orderkey % 3 = 0 then l_returnflag end) as two_units, min(case when i <= 2 and l_orderkey % 3 = 0 then l_returnflag end) as two_unit from c group by 1),
 s as (select *, case when torn then 'completeness_check' when not cited then 'citation_check' when doubled then 'row_selection' when not asked and bad > 0 then 'numeric_parsing' when asked and two_units > 1 or not asked and units > 1 then 'unit_check' end as stage from p)
 select l_orderkey, case when stage is null then 'SUCCESS' else 'INVALID_INPUT' end as status, stage as failure_stage, case when stage is null then (case when asked then two else total end)::double end as value,
 case when stage is null then case when asked then two_unit else unit end end as unit, (case when stage is null then case when asked then 2 else n end else 0 end)::bigint as input_count from s""",
)
def table_statistic_chain(t: Tables) -> DataFrame:
    """An order's lines as a table of one-row chunks: some tables are torn, uncited, asked for rows that are two, unreadable or of mixed units."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    key = F.col("l_orderkey")
    lines = t.lineitem.withColumns({"i": F.row_number().over(order), "n": F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}).where("n > 1")
    at = F.col("i") - 1
    chunks = lines.select("l_orderkey", at.alias("index"), F.col("n").alias("count"), at.alias("start"), (at + F.when(key % 11 == 0, 1).otherwise(0)).alias("end"), F.lit(1).alias("rows"))
    unit = F.when(key % 3 == 0, F.concat(F.lit(" "), "l_returnflag")).otherwise("")
    number = F.concat(F.col("l_quantity").cast("long").cast("string"), unit)
    broken = (F.col("l_linenumber") == 3) & (F.col("i") > 2) & (key % 13 == 0)
    cells = lines.select("l_orderkey", F.concat(F.lit("row "), F.when((key % 10 == 0) & (F.col("i") == 2), 1).otherwise(F.col("i")).cast("string")).alias("label"), F.when(broken, "n/a").otherwise(number).alias("cell"), F.lit(None).cast("string").alias("unit"), (key % 7 != 0).alias("cited"))
    wanted = lines.where((key % 5 == 0) & (F.col("i") <= 2)).select("l_orderkey", F.concat(F.lit(" row "), F.col("i").cast("string")).alias("wanted"))
    return S.table_statistic(chunks, cells, wanted, "l_orderkey", "sum")


for _op, _value in (("sum", "total"), ("mean", "total / n")):

    @query(f"combine_all_{_op}", f"""with g as (select o_custkey, count(*) as n, sum(floor(o_totalprice)::bigint) as total, bool_or(o_orderkey % 9 <> 0) as cited, count(distinct case when o_custkey % 4 = 0 then o_orderstatus else '' end) as units, min(case when o_custkey % 4 = 0 then o_orderstatus end) as unit from orders group by 1),
 s as (select *, case when n < 2 then 'structural' when not cited then 'citation_check' when units > 1 then 'unit_check' end as stage from g)
 select o_custkey, case when stage is null then 'SUCCESS' else 'INVALID_INPUT' end as status, stage as failure_stage, case when stage is null then round({_value}, 3)::double end as value, case when stage is null then unit end as unit, (case when stage is null then n else 0 end)::bigint as input_count from s""")
    def _combined(t: Tables, op: str = _op) -> DataFrame:
        """All orders of a customer as operands."""
        own = F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderstatus"))
        pair = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.col("o_totalprice").cast("long").alias("v"), own.alias("u")))), lambda x: x)
        sets = t.orders.groupBy("o_custkey").agg(pair.alias("p"), F.bool_or(F.col("o_orderkey") % 9 != 0).alias("cited"))
        found = S.combine_all(op, F.transform("p", lambda x: x["v"]), F.transform("p", lambda x: x["u"]), F.col("cited"))
        return sets.select("o_custkey", found.alias("r")).select("o_custkey", "r.status", "r.failure_stage", F.round("r.value", 3).alias("value"), "r.unit", F.col("r.input_count").cast("long").alias("input_count"))


#: The fault that a fragment is given, by its order's key.
_FAULTS = (
    None, "section_id", "evidence_id", "evidence_id_scope", "duplicate_evidence_id", "evidence_order", "evidence_type", "heading_path", "text_payload", "text_role", "captions", "table_text_role",
    "table_type", "kv_storage_mode", "kv_payload", "r_table_storage_mode", "table_id", "table_id_scope", "table_id_order", "record_count_value", "headers", "orphan_record", "record_index", "row_type",
    "row_context", "values", "record_width", "record_count", "record_table_order", "duplicate_table_id", "record_order",
)


def _fragments(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each order as a section of a text, a field table and two record tables of two and one records, with the fault that its key names."""
    fault = F.element_at(F.array(*[F.lit(f) for f in _FAULTS]), (F.col("o_orderkey") % len(_FAULTS) + 1).cast("int"))
    base = t.orders.select(F.col("o_orderkey").cast("string").alias("r"), F.coalesce(fault, F.lit("")).alias("fault"))
    base = base.withColumn("section_id", F.concat(F.when(F.col("fault") == "section_id", "part:").otherwise("section:"), "r", F.lit(":src0:s1")))
    of = lambda name, bad, good: F.when(F.col("fault") == name, bad).otherwise(good)
    text, none = (lambda x: F.lit(x).cast("string")), F.lit(None)
    texts = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    scope = F.concat("r", F.lit(":src0:s"))
    eid = lambda k: F.concat(F.lit("evidence:"), scope, F.lit(f"1:e{k}"))
    tid = lambda k: F.concat(F.lit("rtable:"), scope, F.lit(f"1:t{k}"))
    heads = F.array(texts("품목"), texts("금액", "당기"))
    heads_2 = F.array(texts("품목"), texts("금액", "당기"), F.lit(None).cast("array<string>"))
    rows = [
        dict(evidence_id=of("evidence_id", F.lit("e1"), of("evidence_id_scope", F.concat(F.lit("evidence:"), "r", F.lit(":src9:s1:e0")), eid(0))), ord=of("evidence_order", F.lit(7), F.lit(0)), evidence_type=text("TEXT"), table_type=none, storage_mode=none,
             text=of("text_payload", F.lit("  "), F.lit("본문")), text_role=of("text_role", F.lit("UNIT"), F.lit("BODY")), captions=none, heading_path=of("heading_path", texts("제목", " "), texts("제목")), fields=none, table_id=none, record_count=none, headers=none),
        dict(evidence_id=of("duplicate_evidence_id", eid(0), eid(1)), ord=F.lit(1), evidence_type=of("evidence_type", F.lit("IMAGE"), F.lit("TABLE")), table_type=text("KV_TABLE"), storage_mode=of("kv_storage_mode", F.lit("SECTION_RECORDS"), none),
             text=none, text_role=of("table_text_role", F.lit("BODY"), none), captions=of("captions", texts("같은", "같은"), texts("하나")), heading_path=none, fields=of("kv_payload", none, texts("f")), table_id=none, record_count=none, headers=none),
        dict(evidence_id=eid(2), ord=F.lit(2), evidence_type=text("TABLE"), table_type=text("R_TABLE"), storage_mode=text("SECTION_RECORDS"), text=none, text_role=none, captions=none, heading_path=none, fields=none,
             table_id=of("table_id", F.lit("t0"), of("table_id_scope", F.concat(F.lit("rtable:"), scope, F.lit("2:t0")), of("table_id_order", tid(5), tid(0)))), record_count=of("record_count", F.lit(3), F.lit(2)), headers=heads),
        dict(evidence_id=eid(3), ord=F.lit(3), evidence_type=text("TABLE"), table_type=of("table_type", F.lit("X"), F.lit("R_TABLE")), storage_mode=of("r_table_storage_mode", F.lit("INLINE"), F.lit("SECTION_RECORDS")), text=none, text_role=none, captions=none, heading_path=none, fields=none,
             table_id=of("duplicate_table_id", tid(0), tid(1)), record_count=of("record_count_value", F.lit(-4), F.lit(1)), headers=of("headers", heads_2, heads)),
    ]
    cast = {f.split()[0]: f.split()[1] for f in FR.EVIDENCE.split(", ")}
    items = [F.struct(F.lit(k).alias("pos"), *[v.cast(cast[n]).alias(n) for n, v in row.items()]) for k, row in enumerate(rows)]
    evidence = base.select("section_id", F.inline(F.array(*items)))
    first = rows[2]["table_id"]
    second = of("orphan_record", F.lit("rtable:0:src0:s0:t0"), rows[3]["table_id"])
    record = lambda k, table, index, kind, context, values: F.struct(F.lit(k).alias("pos"), table.alias("table_id"), index.cast("int").alias("record_index"), kind.alias("row_type"), context.alias("row_context"), values.alias("values"))
    swap = F.col("fault") == "record_table_order"
    a = record(0, F.when(swap, second).otherwise(first), F.lit(0), of("row_type", F.lit("SUM"), F.lit("DATA")), of("row_context", F.array(F.lit(None).cast("string")), texts()), of("values", F.array(F.lit("1"), F.lit(None).cast("string")), of("record_width", texts("1"), texts("1", "2"))))
    b = record(1, first, F.when(swap, 0).otherwise(of("record_index", F.lit(-1), of("record_order", F.lit(2), F.lit(1)))), F.lit("TOTAL"), texts("합계"), texts("3", "4"))
    c = record(2, F.when(swap, first).otherwise(second), F.when(swap, 1).otherwise(0), F.lit("DATA"), texts(), texts("5", "6"))
    return base.select("section_id"), evidence, base.select("section_id", F.inline(F.array(a, b, c)))


#: What each planted fault is seen as: a broken id loses its table's records, a table of another kind has none.
_SEEN = {
    "evidence_type": ["evidence_type:1"], "table_type": ["table_type:3"], "r_table_storage_mode": ["r_table_storage_mode:3", "orphan_record:2", "record_table_order:"], "record_count_value": ["record_count_value:3", "record_count:1", "record_order:1", "record_table_order:"], "headers": ["headers:3", "record_width:2"],
    "orphan_record": ["orphan_record:2", "record_count:1", "record_order:1", "record_table_order:"], "record_index": ["record_index:1", "record_order:0"], "record_order": ["record_order:0"], "record_count": ["record_count:0", "record_order:0"], "record_width": ["record_width:0"],
    "row_type": ["row_type:0"], "row_context": ["row_context:0"], "values": ["values:0"], "record_table_order": ["record_table_order:"], "section_id": ["section_id:"], "evidence_id": ["evidence_id:0"], "evidence_id_scope": ["evidence_id_scope:0"],
    "duplicate_evidence_id": ["duplicate_evidence_id:1"], "evidence_order": ["evidence_order:0"], "heading_path": ["heading_path:0"], "text_payload": ["text_payload:0"], "text_role": ["text_role:0"], "captions": ["captions:1"], "table_text_role": ["table_text_role:1"],
    "kv_storage_mode": ["kv_storage_mode:1"], "kv_payload": ["kv_payload:1"], "table_id": ["table_id:2"], "table_id_scope": ["table_id_scope:2"], "table_id_order": ["table_id_order:2"],
    "duplicate_table_id": ["duplicate_table_id:3", "table_id_order:3", "record_count:0", "record_order:0", "record_table_order:"],
}
_NUMBERED = ", ".join("[" + ", ".join(f"'{x}'" for x in _SEEN.get(f, [])) + "]::varchar[]" for f in _FAULTS)


@query("fragment_codes", f"""with s as (select o_orderkey as r, unnest([{_NUMBERED}][o_orderkey % {len(_FAULTS)} + 1]) as c from orders)
 select case when starts_with(c, 'section_id:') then 'part:' else 'section:' end || r || ':src0:s1' as section_id, split_part(c, ':', 1) as code, nullif(split_part(c, ':', 2), '') as place from s""")
def fragment_codes(t: Tables) -> DataFrame:
    """Every fault that was planted is found, by its code and place, and nothing else."""
    found = FR.fragment_faults(*_fragments(t))
    # a table's fault names the table: told here by the number that it has, or had to have
    place = F.when(F.col("code").isin("record_count", "record_order"), F.coalesce(F.nullif(F.regexp_extract("at", r":t(\d+)$", 1), F.lit("")), F.lit("?"))).otherwise(F.col("at"))
    return found.select("section_id", "code", place.alias("place"))


_EVENT = "case o_orderkey % 4 when 0 then '단일판매ㆍ공급계약체결' when 1 then '유상증자결정' when 2 then '소송등의제기' else '기타' end"


@query(
    "disclosure_events",
    f"""with o as (select o_orderkey as k, o_orderkey % 4 as m, {_EVENT} as subtype, o_orderkey % 2 = 0 as exchange, strftime(o_orderdate, '%Y-%m-%d') as receipt, c_name, o_orderpriority as p from orders join customer on o_custkey = c_custkey where o_orderkey % 5 <> 0),
 f as (select *, case m when 0 then '- 계약금액: 100' || chr(10) || '- 계약수주일자: 2024-03-05' || chr(10) || '- 구분: 내용' || chr(10) || '- 비고 > ' || p || ': ' || k when 1 then '- 신주 발행: 100' || chr(10) || '- 이사회결의일(결정일): 2024년 4월 6일' || chr(10) || '- 비고 > ' || p || ': ' || k
  when 2 then '- 확인일자: 20240708' || chr(10) || '- 메모: 100' || chr(10) || '- 구분: 내용' || chr(10) || '- 비고 > ' || p || ': ' || k else '- 메모: 100' || chr(10) || '- 결정일자: 미정' || chr(10) || '- 비고 > ' || p || ': ' || k end as facts from o)
 select k as doc, subtype, ['contract', 'capital_securities', 'legal_risk', 'market_disclosure'][m + 1] as family, ['2024-03-05', '2024-04-06', '2024-07-08', receipt][m + 1] as day, case when m = 3 then 'EVENT_DATE_FALLBACK_TO_RECEIPT_DATE' end as issue,
 c_name || '의 ' || subtype || ' 공시 사건' || chr(10) || chr(10) || '이벤트 분류: ' || ['계약·영업거래', '자본·증권발행', '법률·규제·사고·리스크', '시장·공시·해외'][m + 1] || chr(10) || chr(10) || '핵심 사실' || chr(10) || facts || case when exchange then chr(10) || chr(10) || '보충 설명' || chr(10) || '- 개요: 설명 ' || p else '' end as content,
 case when exchange then '0:0,0:1' else '0:0' end as evidence, 'SUCCESS' as status from f""",
)
def disclosure_events(t: Tables) -> DataFrame:
    """Orders as disclosures of four families: facts by keyword, dates by key, header rows of exchange tables, first sections of major ones; corrections left out."""
    key, m = F.col("o_orderkey"), F.col("o_orderkey") % 4
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (m + 1).cast("int"))
    field = lambda k, v: F.struct(F.array(F.array(k)).alias("key_paths"), v.alias("raw_value"))
    first = F.when(m == 0, field(F.lit("이사회결의일 메모"), F.lit("-"))).otherwise(field(F.lit("작성책임자"), F.lit("홍길동")))
    dated = field(pick(["계약수주일자", "이사회결의일(결정일)", "확인일자", "결정일자"]), pick(["2024-03-05", "2024년 4월 6일", "20240708", "미정"]))
    told = field(pick(["계약금액", "신주 발행", "메모", "메모"]), F.lit("100"))
    row = F.struct(F.lit(0).alias("record_index"), F.lit("DATA").alias("row_type"), F.array(F.lit("비고")).alias("row_context"), F.array("o_orderpriority", F.col("o_orderpriority"), key.cast("string")).alias("values"))
    fields_of = F.when(m == 2, F.array(first, dated)).otherwise(F.array(first, told, dated))
    own, none = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")), F.array().cast("array<string>")
    line = lambda section, ordinal, kind, text, fields, records, heads: F.struct(
        F.lit(section).alias("section"), F.lit(ordinal).alias("ordinal"), F.lit(kind).alias("kind"), text.alias("text"), F.array(F.lit("개요")).alias("heading_path"), F.lit(None).cast("string").alias("title"),
        none.alias("units"), none.alias("captions"), none.alias("notes"), heads.alias("headers"), fields.alias("fields"), records.alias("records"),
    )
    no_fields, no_rows = F.filter(fields_of, lambda x: F.lit(False)), F.filter(F.array(row), lambda x: F.lit(False))
    heads, no_heads = F.array(F.array(F.lit("구분")), F.array(F.lit("내용"))), F.array().cast("array<array<string>>")
    rows = F.array(
        line(0, 0, "TABLE", F.lit(None).cast("string"), fields_of, F.array(row), heads),
        line(0, 1, "TEXT", F.concat(F.lit("설명  "), "o_orderpriority"), no_fields, no_rows, no_heads),
        line(0, 2, "TABLE", F.lit(None).cast("string"), F.array(field(F.lit("정정 사유"), F.lit("오기"))), no_rows, no_heads),
        line(1, 0, "TEXT", F.concat(F.lit("설명 "), "o_orderpriority"), no_fields, no_rows, no_heads),
    )
    # of major disclosures only the table stands in the first section
    evidence = own.select(key.alias("doc"), F.inline(rows)).where("doc % 2 = 0 or not (section = 0 and ordinal = 1)")
    evidence = evidence.withColumn("fields", F.when((F.col("section") == 0) & (F.col("ordinal") == 0) & (F.col("doc") % 4 == 2), F.array_append("fields", field(F.lit("메모"), F.lit("100")))).otherwise(F.col("fields")))
    documents = own.select(
        key.alias("doc"), F.when(key % 2 == 0, "exchange").otherwise("major").alias("doc_group"), (key % 5 != 0).alias("is_latest"), pick(["계약·영업거래", "자본·증권발행", "법률·규제·사고·리스크", "시장·공시·해외"]).alias("event_type"),
        pick(["단일판매ㆍ공급계약체결", "유상증자결정", "소송등의제기", "기타"]).alias("subtype"), F.date_format("o_orderdate", "yyyyMMdd").alias("receipt_date"), F.col("c_name").alias("company"),
    )
    out = DE.build_events(evidence, documents)
    return out.select("doc", "subtype", "family", F.col("event_date").cast("string").alias("day"), "issue", "content", F.array_join("evidence", ",").alias("evidence"), "status")


@query("latest_by_flag", "select o_orderkey, o_orderkey % 3 <> 0 as is_latest from orders")
def latest_by_flag(t: Tables) -> DataFrame:
    """Explicit flags stand on every row, so no chain is asked."""
    docs = t.orders.select("o_orderkey", (F.col("o_orderkey") % 3 != 0).alias("is_latest_version"))
    chain = t.events.select(F.col("user_id").alias("root"), F.col("event_id").alias("receipt"))
    return R.latest_by_flag(docs, chain, "o_orderkey", "root", "receipt").select("o_orderkey", "is_latest")


@query("relabelled_nodes", "select o_orderkey, 'Evidence' || case when o_orderkey % 4 = 0 then ',Table' else ',Text' end as labels from orders")
def relabelled_nodes(t: Tables) -> DataFrame:
    nodes = t.orders.select("o_orderkey", F.array(F.lit("Evidence"), F.lit("Text")).alias("labels"))
    new = t.orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("Table").alias("label"))
    return R.relabelled(nodes, new, "o_orderkey", "label", ["Text", "Table"]).select("o_orderkey", F.array_join("labels", ",").alias("labels"))


@query("element_paths", """with n as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) as i, count(*) over (partition by l_orderkey) as n from lineitem)
 select distinct doc || ':path' as ref, doc, '/DOCUMENT[1]/P[1]' as path from n union all select distinct doc || ':id', doc, '/DOCUMENT[1]/TABLE[' || n || ']' from n union all select distinct doc || ':table', doc, '/DOCUMENT[1]/TABLE[1]' from n union all select distinct doc || ':none', doc, null from n""")
def element_paths(t: Tables) -> DataFrame:
    """References by path, by id and by table number, each to the element that was written."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    lines = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.row_number().over(order).alias("i"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: F.concat(F.lit("<TABLE ID='t"), i.cast("string"), F.lit("'><TR><TD>"), i.cast("string"), F.lit("</TD></TR></TABLE>"))), "")
    docs = lines.groupBy("doc").agg(F.concat(F.lit("<DOCUMENT><P>x</P>"), body, F.lit("</DOCUMENT>")).alias("html"), F.count("*").alias("n"))
    text = lambda x: F.lit(x).cast("string")
    ref = lambda name, path, html_id, table: F.struct(F.concat(F.col("doc").cast("string"), F.lit(f":{name}")).alias("ref"), path.alias("element_path"), html_id.alias("html_id"), table.cast("int").alias("table_index"))
    none = text(None)
    refs = docs.select("doc", F.inline(F.array(
        ref("path", text("/DOCUMENT[1]/P[1]"), text("t1"), F.lit(0)), ref("id", text("/DOCUMENT[1]/P[9]"), F.concat(F.lit("t"), F.col("n").cast("string")), F.lit(0)),
        ref("table", none, text("gone"), F.lit(0)), ref("none", none, none, F.lit(99)),
    )))
    return D.resolve_references(docs, "doc", "html", refs, True)


@query("descriptor_values", """with c as (select p_size as tbl, unnest([0, 1, 2, 3]) as col, unnest(['dimension', 'dimension', 'measure', 'dimension']) as role, p_partkey as pos, unnest([p_brand, p_type, p_retailprice::varchar, 'w' || p_partkey % 16]) as v from part),
 d as (select tbl, col, role, v, min(pos) as p from c where trim(v) <> '' group by all), n as (select tbl, col, role, count(*) as n, list(v order by p, v) as vs from d group by all),
 b as (select *, coalesce(sum(case when role = 'dimension' and n <= 20 then n else 0 end) over (partition by tbl order by col rows between unbounded preceding and 1 preceding), 0) as before from n)
 select tbl, col::int as col, case when role = 'dimension' and n <= 20 and before < 50 then array_to_string(vs[1 : (50 - before)::int], '|') else '' end as shown, case when role <> 'dimension' then null when n > 20 then 'high_cardinality' when before >= 50 or n > 50 - before then 'table_value_limit' end as omitted from b""")
def descriptor_values(t: Tables) -> DataFrame:
    values = F.posexplode(F.array("p_brand", "p_type", F.col("p_retailprice").cast("string"), F.concat(F.lit("w"), (F.col("p_partkey") % 16).cast("string")))).alias("col", "v")
    cells = t.part.select(F.col("p_size").alias("tbl"), F.col("p_partkey").alias("pos"), values)
    roles = cells.select("tbl", "col").distinct().withColumn("role", F.when(F.col("col") == 2, "measure").otherwise("dimension"))
    return P.descriptor_values(cells, roles, "tbl", "col", "pos", "v").select("tbl", "col", F.array_join("shown", "|").alias("shown"), "omitted")


@query("correction_blocks", """select o_orderkey as doc, ['FOUND', 'FOUND', 'NOT_FOUND', 'FAILED'][o_orderkey % 4 + 1] as status, case when o_orderkey % 4 < 2 then strftime(o_orderdate, '%Y-%m-%d') end as correction_date, case when o_orderkey % 4 = 0 then '오기 ' || o_orderkey end as reason from orders""")
def correction_blocks(t: Tables) -> DataFrame:
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    full = F.concat(F.lit("<DOCUMENT><CORRECTION>1. 정정일자 : "), day, F.lit(" 2. 정정사유 : 오기 "), key.cast("string"), F.lit("</CORRECTION></DOCUMENT>"))
    part = F.concat(F.lit("<DOCUMENT><CORRECTION>정정일자: "), day, F.lit("</CORRECTION></DOCUMENT>"))
    html = F.element_at(F.array(full, part, F.lit("<DOCUMENT><P>x</P></DOCUMENT>"), F.lit("no markup")), (key % 4 + 1).cast("int"))
    return D.correction_rows(t.orders.select(key, html.alias("html")), "o_orderkey", "html", True).select("doc", "status", "correction_date", "reason")


@query("field_tables", """select c_custkey as doc, 'KV_TABLE' as type, unnest(['대표이사', '자본금', '설립일']) as key, unnest([c_name, c_custkey::varchar, '2001']) as value from customer""")
def field_tables(t: Tables) -> DataFrame:
    """Tables of keys and values, without end tags, back to their fields."""
    html = F.concat(F.lit("<html><table><tr><td>대표이사<td>"), "c_name", F.lit("<tr><td>자본금<td>"), F.col("c_custkey").cast("string"), F.lit("<tr><td>설립일<td>2001</table>"))
    tables = D.table_rows(t.customer.select("c_custkey", html.alias("html")), "c_custkey", "html", None)
    return tables.select("doc", "type", F.explode("fields").alias("f")).select("doc", "type", F.array_join(F.get("f.key_paths", F.lit(0)), " > ").alias("key"), F.col("f.raw_value").alias("value"))
