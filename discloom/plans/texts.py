"""Queries on text, date, id and payload expressions: cells written from keys, so that SQL knows the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from discloom.functions import numeric as N, text as X
from discloom.operators import projections as PR
from discloom.plans.registry import Tables, query


def _pick(key: Column, values: list[str]) -> Column:
    """The value that the key's remainder names."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _list(values: list[str | None]) -> str:
    return "[" + ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql(key: str, table: str, given: list[str], **columns: list[str | None]) -> str:
    """SQL that names each answer beside what was given."""
    told = ", ".join(f"{_list(v)}[{key} % {len(given)} + 1] as {k}" for k, v in columns.items())
    return f"select {key}, {_list(given)}[{key} % {len(given)} + 1] as given, {told} from {table}"


_NAMES = ["[기재정정]사업보고서 (2023.12)", "주요사항보고서(유상증자 결정)", "반기 보고서", "[첨부정정] 단일판매ㆍ공급계약체결", "주식등의대량보유상황보고서(일반)", "Annual Report", "  ", "[정정]"]
_CLEAN = ["사업보고서 (2023.12)", "유상증자 결정", "반기 보고서", "단일판매ㆍ공급계약체결", "주식등의대량보유상황보고서(일반)", "Annual Report", "", ""]
_COMPACT = ["기재정정사업보고서202312", "주요사항보고서유상증자결정", "반기보고서", "첨부정정단일판매공급계약체결", "주식등의대량보유상황보고서일반", "annualreport", "", "정정"]
_FAMILY = ["사업보고서", "주요사항보고서", "반기보고서", "단일판매공급계약체결", "주식등의대량보유상황보고서", "annualreport", None, None]


@query("report_names", _sql("o_orderkey", "orders", _NAMES, clean=_CLEAN, compact=_COMPACT, family=_FAMILY))
def report_names(t: Tables) -> DataFrame:
    given = _pick(F.col("o_orderkey"), _NAMES)
    return t.orders.select("o_orderkey", given.alias("given"), X.clean_report_name(given).alias("clean"), X.compact_key(given).alias("compact"), X.document_family(given).alias("family"))


_DATES = ["2024년 3월 5일", "결의일: 2024-03-05 예정", "2024.3.5", "20240305", "2024-02-30", "2023년 12월", "날짜 없음", "1999/1/31"]
_FOUND = ["2024-03-05"] * 4 + [None] * 4


@query("found_dates", _sql("o_orderkey", "orders", _DATES, day=_FOUND))
def found_dates(t: Tables) -> DataFrame:
    given = _pick(F.col("o_orderkey"), _DATES)
    return t.orders.select("o_orderkey", given.alias("given"), X.find_date(given).cast("string").alias("day"))


@query("shifted_dates", """select o_orderkey, strftime(o_orderdate, '%Y%m%d') as compact, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate::date + interval 1 month, '%Y-%m-%d') as later, strftime(o_orderdate::date - interval 13 month, '%Y-%m-%d') as earlier from orders""")
def shifted_dates(t: Tables) -> DataFrame:
    """Compact dates read back strictly and leniently, and months away: the last day of a shorter month stands for its missing days."""
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    day = X.strict_date(compact)
    return t.orders.select("o_orderkey", compact.alias("compact"), X.iso_date(compact).alias("iso"), X.shift_month(day, 1).cast("string").alias("later"), X.shift_month(day, -13).cast("string").alias("earlier"))


@query(
    "period_envelope",
    """with p as (select l_orderkey, l_linenumber % 4 as g, o_orderdate::date + l_linenumber::int as d from lineitem join orders on l_orderkey = o_orderkey),
 b as (select l_orderkey, case g when 0 then make_date(year(d), 1, 1) when 1 then make_date(year(d), month(d), 1) else d end as lo, case g when 0 then make_date(year(d), 12, 31) when 1 then last_day(d) when 2 then d else d + 9 end as hi from p)
 select l_orderkey, strftime(min(lo) - interval 1 month, '%Y-%m-%d') as first, strftime(max(hi) + interval 1 month, '%Y-%m-%d') as last from b group by 1""",
)
def period_envelope(t: Tables) -> DataFrame:
    """Periods of four kinds to their bounds; of an order's periods the earliest start and the latest end, a month wider."""
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    day, kind = F.date_add(F.col("o_orderdate").cast("date"), F.col("l_linenumber").cast("int")), F.col("l_linenumber") % 4
    text = F.when(kind == 0, F.date_format(day, "yyyy")).when(kind == 1, F.date_format(day, "yyyy-MM")).when(kind == 2, day.cast("string")).otherwise(F.concat_ws(" ~ ", day.cast("string"), F.date_add(day, 9).cast("string")))
    bounds = X.granular_bounds(_pick(kind, ["YEAR", "MONTH", "DATE", "RANGE"]), text)
    out = lines.select("l_orderkey", bounds.alias("b")).groupBy("l_orderkey").agg(F.min("b.first").alias("lo"), F.max("b.last").alias("hi"))
    return out.select("l_orderkey", X.shift_month(F.col("lo"), -1).cast("string").alias("first"), X.shift_month(F.col("hi"), 1).cast("string").alias("last"))


_PERIODS = ["2024", "2024-02", "2024-02-29", "2023-02-29", "2024-13", "x"]


@query("period_bounds", _sql("o_orderkey", "orders", _PERIODS, first=["2024-01-01", "2024-02-01", "2024-02-29", None, None, None], last=["2024-12-31", "2024-02-29", "2024-02-29", None, None, None]))
def period_bounds(t: Tables) -> DataFrame:
    given = _pick(F.col("o_orderkey"), _PERIODS)
    b = X.period_bounds(given)
    return t.orders.select("o_orderkey", given.alias("given"), b["first"].cast("string").alias("first"), b["last"].cast("string").alias("last"))


@query("company_keys", "select c_custkey, case when c_mktsegment = 'BUILDING' then c_custkey || '|' || lower(regexp_replace(c_name || ' (주)', '[^0-9A-Za-z가-힣_]', '', 'g')) else c_custkey::varchar end as company from customer")
def company_keys(t: Tables) -> DataFrame:
    group = F.when(F.col("c_mktsegment") == "BUILDING", "holding").otherwise("periodic")
    return t.customer.select("c_custkey", X.company_key(F.col("c_custkey").cast("string"), F.concat("c_name", F.lit(" (주)")), group).alias("company"))


@query("point_ids", "select o_orderkey, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (('0x' || h[17])::int % 4 + 1)::int, 1) || h[18:20] || '-' || h[21:32] as point_id, octet_length(encode('{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\",\"n\":null}')) as bytes from (select o_orderkey, o_orderstatus, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(o_orderkey || ':whole')) as h from orders)")
def point_ids(t: Tables) -> DataFrame:
    """Name-based ids and the size of a payload's compact JSON, both in the JVM."""
    size = X.json_size(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.lit(None).cast("string").alias("n")))
    return t.orders.select("o_orderkey", X.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.concat(F.col("o_orderkey").cast("string"), F.lit(":whole"))).alias("point_id"), size.cast("long").alias("bytes"))


_LABELS = ["소 계", "총 계", "부문 합계", "매출", "계", "합 계 소계"]


@query("row_types", _sql("o_orderkey", "orders", _LABELS, type=["SUBTOTAL", "TOTAL", "TOTAL", "DATA", "DATA", "SUBTOTAL"]))
def row_types(t: Tables) -> DataFrame:
    given = _pick(F.col("o_orderkey"), _LABELS)
    return t.orders.select("o_orderkey", given.alias("given"), X.row_type(F.array(F.lit("x"), given)).alias("type"))


_BROKEN = ["<a>R&D</a>", "<a>3 < 4 &amp; 5</a>", "<a>\x01x&#38;&#x26;</a>", "<a>see <the note></a>", "<a b='c d'>&lt;ok&gt;</a>", "&a; <", "<br />"]
_MENDED = ["<a>R&amp;D</a>", "<a>3 &lt; 4 &amp; 5</a>", "<a>x&#38;&#x26;</a>", "<a>see &lt;the note></a>", "<a b='c d'>&lt;ok&gt;</a>", "&amp;a; <", "&lt;br />"]


@query("repaired_markup", _sql("o_orderkey", "orders", _BROKEN, mended=_MENDED).replace("'<a>\x01x", "'<a>' || chr(1) || 'x"))
def repaired_markup(t: Tables) -> DataFrame:
    given = _pick(F.col("o_orderkey"), _BROKEN)
    return t.orders.select("o_orderkey", given.alias("given"), X.repair_markup(given).alias("mended"))


_CAPS = ["1,234", " 5 ", "", "n/a", "12,345,678"]


@query("market_caps", "select o_orderkey, ['1,234', ' 5 ', '', 'n/a', '12,345,678'][o_orderkey % 5 + 1] as given, [1234, 5, null, null, 12345678][o_orderkey % 5 + 1]::bigint as cap, ['1,234억원', '5억원', null, null, '12,345,678억원'][o_orderkey % 5 + 1] as told from orders")
def market_caps(t: Tables) -> DataFrame:
    given = _pick(F.col("o_orderkey"), _CAPS)
    cap = N.parse_market_cap(given)
    return t.orders.select("o_orderkey", given.alias("given"), cap.alias("cap"), PR.market_cap_text(cap).alias("told"))


@query("json_scalars", "select o_orderkey, o_totalprice::decimal(18,2)::varchar as price, strftime(o_orderdate, '%Y-%m-%d') as day, lower(hex(encode(o_orderpriority))) as raw, o_orderstatus as status from orders")
def json_scalars(t: Tables) -> DataFrame:
    price, day, raw = F.col("o_totalprice").cast("decimal(18,2)"), F.col("o_orderdate").cast("date"), F.encode("o_orderpriority", "UTF-8")
    return t.orders.select("o_orderkey", PR.json_scalar(price, "decimal(18,2)").alias("price"), PR.json_scalar(day, "date").alias("day"), PR.json_scalar(raw, "binary").alias("raw"), PR.json_scalar(F.col("o_orderstatus"), "string").alias("status"))


_ERRORS = [("ReadTimeout", "x"), ("ServiceError", "request timed out"), ("QuerySyntaxError", "x"), ("ValueError", "Bad Request"), ("OSError", "gone"), ("ValidationError", "timed out")]


@query("error_classes", f"select o_orderkey, {_list(['TIMEOUT', 'TIMEOUT', 'INVALID_QUERY', 'INVALID_QUERY', 'ERROR', 'TIMEOUT'])}[o_orderkey % 6 + 1] as direct, {_list(['TIMEOUT', 'TIMEOUT', 'INVALID_QUERY', 'INVALID_QUERY', 'ERROR', 'TIMEOUT'])}[o_orderkey % 6 + 1] as caused from orders")
def error_classes(t: Tables) -> DataFrame:
    """Alone, and as the cause of an exception that tells nothing."""
    name, told = (_pick(F.col("o_orderkey"), [e[k] for e in _ERRORS]) for k in (0, 1))
    blank = F.lit("RuntimeError")
    return t.orders.select("o_orderkey", PR.error_class(F.array(name), F.array(told)).alias("direct"), PR.error_class(F.array(blank, name), F.array(F.lit("failed"), told)).alias("caused"))


_NOTES = ["자료가 부족합니다", "없음", "N/A", "Not  Available in filings", "모두 확인", "-"]


@query("notes", f"select o_orderkey, {_list(_NOTES)}[o_orderkey % 6 + 1] as given, [true, false, false, true, false, false][o_orderkey % 6 + 1] as limits, {_list(['자료가 부족합니다', None, None, 'Not Available in filings', '모두 확인', None])}[o_orderkey % 6 + 1] as kept from orders")
def notes(t: Tables) -> DataFrame:
    given = _pick(F.col("o_orderkey"), _NOTES)
    return t.orders.select("o_orderkey", given.alias("given"), PR.is_limitation(given).alias("limits"), PR.real_note(given).alias("kept"))


@query("header_lines", """with p as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) as i, l_linenumber, l_returnflag as parent, l_linenumber::varchar as leaf from lineitem where l_linenumber < 6),
 g as (select l_orderkey, parent, min(i) as first, list(distinct leaf order by leaf) as leaves from p group by all),
 n as (select l_orderkey, first, case when len(leaves) > 1 then parent || ' : ' || array_to_string(leaves, ' | ') else parent || ' > ' || leaves[1] end as line from g)
 select l_orderkey, '품목' || coalesce(chr(10) || string_agg(line, chr(10) order by first), '') as lines from n group by 1""")
def header_lines(t: Tables) -> DataFrame:
    """Columns under one parent share a line; their leaves stand in the order of the lines."""
    pair = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    paths = F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.array(x["l_returnflag"], x["l_linenumber"].cast("string")))
    heads = t.lineitem.where("l_linenumber < 6").groupBy("l_orderkey").agg(F.concat(F.array(F.array(F.lit("품목")), F.array(F.lit(" "))), paths).alias("h"))
    return heads.select("l_orderkey", F.array_join(PR.grouped_header_lines(F.col("h")), "\n").alias("lines"))


@query("table_metadata", "select o_orderkey, case when o_orderkey % 3 <> 0 then o_orderpriority end as title, case when o_orderkey % 2 = 0 then '원' end as units, o_orderstatus || ',x' as captions from orders")
def table_metadata(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    meta = PR.table_metadata(F.when(key % 3 == 0, " ").otherwise(F.col("o_orderpriority")), units=F.when(key % 2 == 0, F.array(F.lit("원"), F.lit(" "))).otherwise(F.array(F.lit(""))), captions=F.array("o_orderstatus", F.lit(" "), F.lit("x")))
    return t.orders.select(key, meta.alias("m")).select("o_orderkey", "m.title", F.array_join("m.units", ",").alias("units"), F.array_join("m.captions", ",").alias("captions"))


@query("compaction_needed", "select o_custkey, count(*) > 10 or length('[' || string_agg('\"' || o_orderpriority || o_orderkey || '\"', ',') || ']') > 250 as needed from orders group by 1")
def compaction_needed(t: Tables) -> DataFrame:
    items = F.collect_list(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")))
    return t.orders.groupBy("o_custkey").agg(items.alias("i")).select("o_custkey", PR.needs_compaction(F.col("i"), 10, 250).alias("needed"))


@query("named_values", "select o_orderkey, o_orderstatus || ',' || o_orderpriority as found, o_orderpriority as first from orders")
def named_values(t: Tables) -> DataFrame:
    """Texts under a name at two depths of a nested payload, and the first under either of two names."""
    nested = F.to_json(F.struct(F.struct(F.col("o_orderstatus").alias("id"), F.array(F.struct(F.col("o_orderpriority").alias("id"), F.col("o_orderstatus").alias("title"))).alias("kids")).alias("a"), F.col("o_orderpriority").alias("name")))
    return t.orders.select("o_orderkey", F.array_join(PR.named_values(nested, "id"), ",").alias("found"), PR.first_named(nested, ["missing", "name"]).alias("first"))


@query("checked_context", "select o_orderkey, c_name as company, o_orderpriority as report from orders join customer on o_custkey = c_custkey")
def checked_context(t: Tables) -> DataFrame:
    """The head lines of a contextual text are what its metadata say, or the query fails."""
    met = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    text = F.concat(F.lit("company: "), "c_name", F.lit("\nreport: "), "o_orderpriority", F.lit("\n\nbody: x"))
    found = PR.checked_context(text, {"company": F.col("c_name"), "report": F.col("o_orderpriority")})
    return met.select("o_orderkey", found.alias("f")).select("o_orderkey", "f.company", "f.report")


@query("declared_records", "select o_orderkey, 'record' as type, o_orderstatus as status, case when o_orderkey % 2 = 0 then o_orderpriority end as priority from orders")
def declared_records(t: Tables) -> DataFrame:
    """Only declared columns, as one typed record."""
    wide = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("priority"), F.lit(1).alias("secret"))
    own = PR.declared(wide, ["o_orderkey", "status", "priority", "other"])
    return own.select("o_orderkey", PR.as_record(**{c: F.col(c) for c in own.columns if c != "o_orderkey"}).alias("r")).select("o_orderkey", "r.type", "r.fields.status", "r.fields.priority")
