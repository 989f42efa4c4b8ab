"""Queries on numeric cells, statistics and combinations of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from discloom.functions.numeric import parse_numeric_cell
from discloom.operators import statistics as S
from discloom.plans.registry import Tables, query

# Cells of lineitem as a filing would print them, by line number.
CELL_SQL = """case l_linenumber % 9
 when 0 then format('{:,}', (l_quantity::bigint * 1000 + l_partkey))
 when 1 then '(' || format('{:,}', l_quantity::bigint * 1000) || ')'
 when 2 then (l_quantity::bigint)::varchar || '.5%' when 3 then '-' when 4 then '1,2,3' when 5 then ' ' || (l_partkey)::varchar || ' KRW '
 when 6 then '+' || (l_suppkey)::varchar || '.25' when 7 then '' else '(' || (l_quantity::bigint)::varchar || ') x' end"""


def cell(q: Column, part: Column, supp: Column, line: Column) -> Column:
    n, text = q.cast("long"), lambda x: x.cast("string")
    k = line % 9
    return (
        F.when(k == 0, F.format_number(n * 1000 + part, 0)).when(k == 1, F.concat(F.lit("("), F.format_number(n * 1000, 0), F.lit(")"))).when(k == 2, F.concat(text(n), F.lit(".5%")))
        .when(k == 3, "-").when(k == 4, "1,2,3").when(k == 5, F.concat(F.lit(" "), text(part), F.lit(" KRW "))).when(k == 6, F.concat(F.lit("+"), text(supp), F.lit(".25")))
        .when(k == 7, "").otherwise(F.concat(F.lit("("), text(n), F.lit(") x")))
    )


_RE = r"^([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)(.*)$"
PARSE_SQL = f"""
 cells as (select l_orderkey, l_linenumber, l_partkey, {CELL_SQL} as c from lineitem),
 bodies as (select *, trim(c) as t, case when trim(c) like '(%)' then trim(substr(trim(c), 2, length(trim(c)) - 2)) else trim(c) end as b, trim(c) like '(%)' as w from cells),
 parts as (select *, b in ('', '-') as miss, regexp_extract(b, '{_RE}', 1) as num, trim(regexp_extract(b, '{_RE}', 2)) as rest from bodies),
 parsed as (select *, not miss and (num = '' or regexp_matches(rest, '^[+\\-.,]|\\d')) as bad,
   case when not miss and num <> '' and not regexp_matches(rest, '^[+\\-.,]|\\d') then
     case when w then -abs(replace(num, ',', '')::decimal(28,10)) else replace(num, ',', '')::decimal(28,10) end end as v,
   case when not miss and num <> '' and not regexp_matches(rest, '^[+\\-.,]|\\d') and rest <> '' then rest end as u from parts)"""


@query("numeric_cell_parse", f"with {PARSE_SQL} select l_orderkey, l_linenumber, l_partkey, c as cell, v::double as value, u as unit, miss as is_missing, bad as is_invalid from parsed")
def numeric_cell_parse(t: Tables) -> DataFrame:
    cells = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", cell(F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")).alias("cell"))
    p = parse_numeric_cell(F.col("cell"))
    return cells.withColumn("p", p).select("l_orderkey", "l_linenumber", "l_partkey", "cell", F.col("p.value").cast("double").alias("value"), "p.unit", "p.is_missing", "p.is_invalid")


def _amounts(t: Tables) -> DataFrame:
    """Quantities as cells; a supplier's table has a bad cell where l_tax is 0.08 and the key divides by 50, and units by part."""
    q = F.col("l_quantity").cast("long").cast("string")
    text = F.when((F.col("l_suppkey") % 7 == 0) & (F.col("l_linenumber") == 7), "n/a").when(F.col("l_linenumber") == 6, "-").when(F.col("l_suppkey") % 5 == 0, F.concat(q, F.when(F.col("l_partkey") % 2 == 0, " kg").otherwise(" t"))).otherwise(q)
    return t.lineitem.select("l_suppkey", text.alias("cell"))


_STAT_CELLS = """cells as (select l_suppkey, case when l_suppkey % 7 = 0 and l_linenumber = 7 then 'n/a' when l_linenumber = 6 then '-'
 when l_suppkey % 5 = 0 then (l_quantity::bigint)::varchar || case when l_partkey % 2 = 0 then ' kg' else ' t' end else (l_quantity::bigint)::varchar end as c from lineitem),
 p as (select l_suppkey, c = 'n/a' as bad, try_cast(split_part(c, ' ', 1) as bigint) as v, nullif(split_part(c, ' ', 2), '') as u from cells)"""


def _stat_sql(value: str, fails: str = "false") -> str:
    return f"""with {_STAT_CELLS}, modes as (select l_suppkey, v, count(*) as c from p where v is not null group by all),
 best as (select l_suppkey, max(c) as top from modes group by 1), tied as (select m.l_suppkey, count(*) > 1 as tie, max(m.v) as mode_value from modes m join best b on m.l_suppkey = b.l_suppkey and m.c = b.top group by 1),
 g as (select p.l_suppkey, count(v) as n, {value} as v, count(*) filter (where bad) as bad, count(distinct u) as units, min(u) as u, any_value(t.tie) as tie from p left join tied t on p.l_suppkey = t.l_suppkey group by p.l_suppkey),
 s as (select *, case when bad > 0 then 'numeric_parsing' when units > 1 then 'unit_check' when n = 0 then 'numeric_parsing' when {fails} then 'calculation' end as stage from g)
 select l_suppkey, case when stage is null then 'SUCCESS' else 'INVALID_INPUT' end as status, stage as failure_stage, round(case when stage is null then v end, 6) as value, case when stage is null then u end as unit, (case when stage is null then n else 0 end)::bigint as input_count from s"""


for _op, _value, _fails in (
    ("sum", "sum(v)::double", "false"), ("mean", "avg(v)::double", "false"), ("median", "median(v)::double", "false"), ("max", "max(v)::double", "false"), ("min", "min(v)::double", "false"),
    ("mode", "any_value(t.mode_value)::double", "tie"), ("stdev", "stddev_samp(v)::double", "n < 2"),
):

    @query(f"table_stat_{_op}", _stat_sql(_value, _fails))
    def _statistic(t: Tables, op: str = _op) -> DataFrame:
        return S.column_statistic(_amounts(t), ["l_suppkey"], "cell", op).withColumn("value", F.round("value", 6))


@query(
    "unit_consistency",
    """with c as (select l_suppkey, case when l_linenumber % 3 = 0 then p_brand end as u, case when l_suppkey % 4 = 0 then 'KRW' when l_linenumber = 1 then 'USD' when l_linenumber = 2 and l_suppkey % 3 = 0 then 'EUR' end as tu
 from lineitem join part on l_partkey = p_partkey where l_suppkey % 2 = 0 or l_linenumber % 3 <> 0),
 g as (select l_suppkey, count(distinct u) as nu, min(u) as u, count(distinct tu) as nt, min(tu) as tu from c group by 1)
 select l_suppkey, nu > 1 or (nu = 0 and nt > 1) as conflict, case when not (nu > 1 or (nu = 0 and nt > 1)) then coalesce(u, tu) end as unit from g""",
)
def unit_consistency(t: Tables) -> DataFrame:
    line = F.col("l_linenumber")
    cells = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).where((F.col("l_suppkey") % 2 == 0) | (line % 3 != 0))
    table = F.when(F.col("l_suppkey") % 4 == 0, "KRW").when(line == 1, "USD").when((line == 2) & (F.col("l_suppkey") % 3 == 0), "EUR")
    return S.unit_agreement(cells.select("l_suppkey", F.when(line % 3 == 0, F.col("p_brand")).alias("u"), table.alias("tu")), ["l_suppkey"], "u", "tu")


@query(
    "table_completeness",
    """with c as (select l_orderkey, l_linenumber - 1 as i, count(*) over (partition by l_orderkey) + (l_orderkey % 11 = 0)::int as n, (l_linenumber - 1) * 10 as s, (l_linenumber - 1) * 10 + 9 - (l_orderkey % 13 = 0)::int as e, 10 as r from lineitem),
 w as (select *, coalesce(s <> lag(e) over (partition by l_orderkey order by i, s) + 1, false) as gap from c),
 g as (select l_orderkey, count(*) as k, min(n) as lo, max(n) as hi, min(i) as f, max(i) as l, count(distinct i) as d, min(s) as s, bool_or(e - s + 1 <> r) as len, bool_or(gap) as gap from w group by 1),
 x as (select l_orderkey, case when lo < 2 or lo <> hi then 'chunk_count' when f < 0 or l >= hi then 'index_range' when d < k then 'repeated_index' when d < hi then 'missing_index' when s <> 0 then 'row_start' when len then 'row_range' when gap then 'contiguity' end as reason from g)
 select l_orderkey, reason is null as complete, reason from x""",
)
def table_completeness(t: Tables) -> DataFrame:
    i = F.col("l_linenumber") - 1
    # of the whole partition, in the order that completeness() sorts by, so that one sort serves both
    whole = Window.partitionBy("l_orderkey").orderBy(i, i * 10).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(whole) + (F.col("l_orderkey") % 11 == 0).cast("int")
    chunks = t.lineitem.select("l_orderkey", i.alias("i"), n.alias("n"), (i * 10).alias("s"), (i * 10 + 9 - (F.col("l_orderkey") % 13 == 0).cast("int")).alias("e"), F.lit(10).alias("r"))
    return S.completeness(chunks, "l_orderkey", "i", "n", "s", "e", "r")


@query("row_selector", """with w as (select * from (values ('Customer#000000005', 0), ('Customer#000000001 ', 1), ('Customer#000000003', 2)) v(label, position)), k as (select *, trim(c_name) as l from customer)
 select position, c_custkey, c_name, c_acctbal from w join k on trim(label) = l where (select bool_and(coalesce(h, 0) = 1) from w left join (select l, count(*) as h from k group by 1) c on trim(label) = c.l) and not exists (select 1 from customer where c_name is null)""")
def row_selector(t: Tables) -> DataFrame:
    wanted = t.spark.createDataFrame([("Customer#000000005", 0), ("Customer#000000001 ", 1), ("Customer#000000003", 2)], "label string, pos int")
    return S.select_rows(t.customer, "c_name", wanted, "label", "pos").select("position", "c_custkey", "c_name", "c_acctbal")


def _yearly(t: Tables) -> DataFrame:
    """Each customer's totals of consecutive years: a and b."""
    year = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    order = Window.partitionBy("o_custkey").orderBy("y")
    return year.select("o_custkey", "y", F.lag("v").over(order).alias("a"), F.col("v").alias("b"), (F.col("y") - F.lag("y").over(order)).alias("periods"))


_YEARLY = """with y as (select o_custkey, year(o_orderdate) as y, sum(o_totalprice::decimal(18,2)) as v from orders group by all),
 p as (select o_custkey, y, (lag(v) over w)::double as a, v::double as b, y - lag(y) over w as n from y window w as (partition by o_custkey order by y))"""

for _op, _sql in (
    ("sum", "a + b"), ("mean", "(a + b) / 2"), ("difference", "a - b"), ("ratio", "a / nullif(b, 0)"), ("percent_ratio", "a / nullif(b, 0) * 100"), ("percent_change", "(b - a) / nullif(a, 0) * 100"), ("cagr", "(pow(b / nullif(a, 0), 1.0 / n) - 1) * 100"),
):
    _unit = "'%'" if _op.startswith("percent") or _op == "cagr" else "null::varchar" if _op == "ratio" else "'KRW'"
    _null = "null::varchar"

    @query(f"combine_{_op}", f"{_YEARLY} select o_custkey, y::int as y, case when a is null then 'INVALID_INPUT' else 'SUCCESS' end as status, case when a is null then 'structural' end as failure_stage, round({_sql}, 4) as value, case when a is not null then {_unit} end as unit from p")
    def _combine(t: Tables, op: str = _op) -> DataFrame:
        pairs = _yearly(t)
        found = S.combine(op, F.col("a"), F.col("b"), F.col("periods"), F.lit("KRW"), F.lit("KRW"))
        return pairs.withColumn("r", found).select("o_custkey", "y", "r.status", "r.failure_stage", F.round("r.value", 4).alias("value"), "r.unit")


@query("combine_ordering", """with v as (select o_custkey, count(*) as orders from orders group by 1)
 select c_nationkey, o_custkey, orders, row_number() over (partition by c_nationkey order by orders desc, o_custkey) as rank from v join customer on o_custkey = c_custkey""")
def combine_ordering(t: Tables) -> DataFrame:
    totals = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    return S.ordering(totals, ["c_nationkey"], "orders", "o_custkey")


@query("yoy_average_ratio", """with y as (select year(o_orderdate)::int as y, count(*) as n, count(*) filter (where o_orderstatus = 'F') as f from orders group by 1)
 select y, f as finished, round(f / ((n + lag(n) over (order by y)) / 2.0) * 100, 6) as percent from y""")
def yoy_average_ratio(t: Tables) -> DataFrame:
    years = t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    mean = (F.col("n") + F.lag("n").over(Window.orderBy("y"))) / 2  # a row for each year
    return years.select("y", "finished", F.round(F.col("finished") / mean * 100, 6).alias("percent"))


@query("ranked_latest_totals", """with c as (select o_custkey, o_orderkey, o_orderdate, o_totalprice, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders),
 s as (select c_mktsegment, c_custkey, sum(o_totalprice::decimal(18,2))::double as total, count(*) as n from c join customer on o_custkey = c_custkey where rn <= 3 group by all)
 select c_mktsegment, c_custkey, 'SUCCESS' as status, total as value, n as input_count, row_number() over (partition by c_mktsegment order by total desc, c_custkey) as rank from s""")
def ranked_latest_totals(t: Tables) -> DataFrame:
    """Latest filter, scope join, strict reading of text amounts, checks, sum, stable rank: the whole path of a question."""
    latest = t.orders.withColumn("rn", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))).where("rn <= 3")
    cells = latest.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "c_custkey", F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2).alias("cell"))
    stat = S.column_statistic(cells, ["c_mktsegment", "c_custkey"], "cell", "sum")
    return S.ordering(stat, ["c_mktsegment"], "value", "c_custkey").select("c_mktsegment", "c_custkey", "status", "value", "input_count", "rank")
