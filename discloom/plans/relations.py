"""Queries on filters, joins, dedupes, chains, windows, limits and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from discloom.operators import relational as R
from discloom.plans.registry import Tables, query
from discloom.plans.scope import Filter, Scope, conjunction


@query("filter_match_any", "select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH')")
def filter_match_any(t: Tables) -> DataFrame:
    rule = conjunction([Filter("o_orderstatus", match="F"), Filter("o_orderpriority", any_of=("1-URGENT", "2-HIGH"))])
    return t.orders.where(rule).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("filter_merged_ids", "select o_orderkey, o_totalprice from orders where o_orderkey in (1, 2, 3, 7, 32) and o_orderstatus in ('O', 'F')")
def filter_merged_ids(t: Tables) -> DataFrame:
    rule = conjunction([Filter("o_orderkey", match=1), Filter("o_orderkey", any_of=(2, 3)), Filter("o_orderkey", any_of=(7, 32)), Filter("o_orderstatus", any_of=("O", "F"))], id_fields={"o_orderkey"})
    return t.orders.where(rule).select("o_orderkey", "o_totalprice")


for _level, _ids, _where in (("global", (), "true"), ("company", (7, 8, 9), "o_custkey in (7, 8, 9)"), ("disclosure", (1, 2, 5, 6), "o_orderkey in (1, 2, 5, 6)"), ("section", (3, 11), "l_partkey in (3, 11)")):

    @query(f"filter_scope_{_level}", f"select o_custkey, o_orderkey, l_partkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey where {_where}")
    def _scoped(t: Tables, level: str = _level, ids: tuple = _ids) -> DataFrame:
        rule = Scope(level.upper(), ids).predicate({"COMPANY": "o_custkey", "DISCLOSURE": "o_orderkey", "SECTION": "l_partkey"})
        joined = t.orders.select("o_custkey", "o_orderkey").join(t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"))
        return joined.where(rule).select("o_custkey", "o_orderkey", "l_partkey", "l_linenumber")


@query("date_range_widened", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders where o_orderdate::date between date '1995-03-31' - interval 1 month and date '1995-03-31' + interval 1 month")
def date_range_widened(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    edge = F.lit("1995-03-31").cast("date")
    return t.orders.where(R.widened_range(day, edge, edge)).select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("closed_domain_violations", "select v as value from (values ('FRANCE'), ('ATLANTIS'), ('GERMANY'), ('MU')) p(v) where v not in (select n_name from nation)")
def closed_domain_violations(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame([("FRANCE",), ("ATLANTIS",), ("GERMANY",), ("MU",)], "value string")
    return asked.join(t.nation.select(F.col("n_name").alias("value")).distinct(), "value", "left_anti")


@query("manifest_valid_rows", "select o_orderkey, o_orderstatus from orders where o_orderkey is not null and o_orderstatus in ('O', 'F') and o_totalprice > 0")
def manifest_valid_rows(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderkey").isNotNull() & F.col("o_orderstatus").isin("O", "F") & (F.col("o_totalprice") > 0)).select("o_orderkey", "o_orderstatus")


@query("manifest_inner_join", "select o_orderkey, count(*)::bigint as lines from orders join lineitem on o_orderkey = l_orderkey group by 1")
def manifest_inner_join(t: Tables) -> DataFrame:
    # lines are counted before the join: the join then meets one row for each key
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return t.orders.select("o_orderkey").join(lines, "o_orderkey")


@query("lookup_total", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def lookup_total(t: Tables) -> DataFrame:
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return R.total_lookup(t.orders.select("o_orderkey", "o_custkey"), names, ["o_custkey"], "c_name").select("o_orderkey", "c_name")


@query("orphan_records", "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus <> 'P')")
def orphan_records(t: Tables) -> DataFrame:
    return R.missing_endpoints(t.lineitem.select("l_orderkey", "l_linenumber"), t.orders.where("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey")


@query("publishes_edges", "select c_name, o_orderkey, o_orderpriority as doc_group from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING'")
def publishes_edges(t: Tables) -> DataFrame:
    own = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return own.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "o_orderkey", F.col("o_orderpriority").alias("doc_group"))


@query("optional_match", "select c_custkey, max(o_orderkey) as latest, count(o_orderkey)::bigint as n from customer left join orders on c_custkey = o_custkey group by 1")
def optional_match(t: Tables) -> DataFrame:
    known = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("latest"), F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(known, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("missing_endpoints", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def missing_endpoints(t: Tables) -> DataFrame:
    return R.missing_endpoints(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey")


@query("hierarchy_closure", """with recursive e as (select 'region:' || r_regionkey as child, 'world' as parent from region union all select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation union all select 'customer:' || c_custkey, 'nation:' || c_nationkey from customer),
 w as (select child, parent as ancestor, 1 as depth from e union all select w.child, e.parent, depth + 1 from w join e on w.ancestor = e.child) select child as node, ancestor, depth from w""")
def hierarchy_closure(t: Tables) -> DataFrame:
    part = lambda name, key: F.concat(F.lit(name), F.col(key).cast("string"))
    edges = t.region.select(part("region:", "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    edges = edges.unionAll(t.nation.select(part("nation:", "n_nationkey"), part("region:", "n_regionkey"))).unionAll(t.customer.select(part("customer:", "c_custkey"), part("nation:", "c_nationkey")))
    return R.closure(edges, "child", "parent")


_CHAIN = "c as (select user_id as root, event_id as receipt, event_type from events where event_type in ('error', 'purchase'))"


def _corrections(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_type").isin("error", "purchase")).select(F.col("user_id").alias("root"), F.col("event_id").alias("receipt"), "event_type")


@query("correction_history", f"with {_CHAIN} select root, receipt, event_type, row_number() over w as seq, coalesce(lag(receipt) over w, root) as target, lead(receipt) over w is null as is_latest from c window w as (partition by root order by receipt)")
def correction_history(t: Tables) -> DataFrame:
    return R.correction_chain(_corrections(t), "root", "receipt")


@query("latest_version", "with c as (select user_id, event_id from events where event_type = 'error'), l as (select user_id, max(event_id) as last from c group by 1) select e.event_id, not exists (select 1 from c join l using (user_id) where c.event_id = e.event_id and l.last <> c.event_id) and not exists (select 1 from c where c.user_id = e.event_id) as is_latest from events e")
def latest_version(t: Tables) -> DataFrame:
    chain = t.events.where("event_type = 'error'").select(F.col("user_id").alias("root"), F.col("event_id").alias("receipt"))
    return R.latest_versions(t.events.select("event_id"), chain, "event_id", "root", "receipt")


@query("correction_target_resolution", """with s as (select o_orderkey as src, lpad(o_orderkey::varchar, 14, '0') as receipt, strftime(o_orderdate + to_days((o_orderkey % 3)::int), '%Y-%m-%d') as d, case when o_orderkey % 7 <> 0 then o_orderpriority end as g, case when o_orderkey % 4 <> 0 then o_custkey % 40 end as k, o_orderstatus || (o_orderkey % 5) as n, o_orderstatus as f from orders),
 c as (select lpad(o_orderkey::varchar, 14, '0') as receipt, strftime(o_orderdate, '%Y-%m-%d') as d, o_orderpriority as g, o_custkey % 40 as k, o_orderstatus || (o_orderkey % 5) as n, o_orderstatus as f from orders),
 m as (select s.src, c.receipt, c.receipt is not null and coalesce(s.g = c.g, true) as gr, s.k is null or s.k = c.k as co, s.n = c.n as ex, s.f = c.f as ki from s left join c on s.d = c.d and s.receipt <> c.receipt and c.receipt < s.receipt),
 a as (select src, count(receipt) as dated, count(*) filter (where gr) as g, count(*) filter (where gr and co) as own, count(*) filter (where gr and co and ex) as ex, count(*) filter (where gr and co and ki) as ki,
  min(receipt) filter (where gr and co) as ro, min(receipt) filter (where gr and co and ex) as re, min(receipt) filter (where gr and co and ki) as rk from m group by 1),
 r as (select *, case when dated = 0 then 'DATE_NOT_FOUND' when g = 0 then 'GROUP_MISMATCH' when own = 0 then 'COMPANY_MISMATCH' when ex = 1 then 'EXACT' when ex > 1 then 'AMBIGUOUS' when ki = 1 then 'DOCUMENT_FAMILY_RECOVERED' when ki > 1 then 'AMBIGUOUS' when own = 1 then 'UNIQUE_CANDIDATE_RECOVERED' else 'AMBIGUOUS' end as code from a)
 select src, code, case code when 'EXACT' then re when 'DOCUMENT_FAMILY_RECOVERED' then rk when 'UNIQUE_CANDIDATE_RECOVERED' then ro end as target from r""")
def correction_target_resolution(t: Tables) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    base = {"receipt": F.lpad(key.cast("string"), 14, "0"), "name": F.concat("o_orderstatus", (key % 5).cast("string")), "family": F.col("o_orderstatus")}
    sources = t.orders.select(
        key.alias("src"), *[v.alias(k) for k, v in base.items()], F.date_format(F.date_add(day, (key % 3).cast("int")), "yyyy-MM-dd").alias("original_date"),
        F.when(key % 7 != 0, F.col("o_orderpriority")).alias("doc_group"), F.when(key % 4 != 0, F.col("o_custkey") % 40).alias("company"),
    )
    candidates = t.orders.select(*[v.alias(k) for k, v in base.items()], F.date_format(day, "yyyy-MM-dd").alias("submitted"), F.col("o_orderpriority").alias("doc_group"), (F.col("o_custkey") % 40).alias("company"))
    return R.resolve_corrections(sources, candidates)


_PREFIXES = [("P", 9), ("Part", 8), ("Part#0000000", 7), ("Part#00000001", 3), ("Part#00000001", 2), ("Part#000000012", 5), ("Q", 1)]


@query("longest_prefix_category", f"""with c as (select * from (values {", ".join(f"('{p}', {r})" for p, r in _PREFIXES)}) v(prefix, no)),
 m as (select p_partkey, p_name, prefix, no, row_number() over (partition by p_partkey order by length(prefix) desc, no) as rn from part left join c on starts_with(p_name, prefix)) select p_partkey, p_name, prefix, no::int as no from m where rn = 1""")
def longest_prefix_category(t: Tables) -> DataFrame:
    return R.longest_prefix(t.part.select("p_partkey", "p_name"), "p_name", t.spark.createDataFrame(_PREFIXES, "prefix string, no int"), "prefix", "no")


@query("composite_semi", "select l_orderkey, l_linenumber from lineitem where exists (select 1 from part join supplier on p_size = s_nationkey where p_partkey = l_partkey and s_suppkey = l_suppkey)")
def composite_semi(t: Tables) -> DataFrame:
    met = t.lineitem.join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    pairs = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("p_size"))
    return met.join(pairs, ["l_suppkey", "p_size"], "left_semi").select("l_orderkey", "l_linenumber")


@query("composite_anti", "select l_orderkey, l_linenumber from lineitem l where not exists (select 1 from lineitem m where m.l_orderkey = l.l_orderkey and m.l_suppkey = l.l_suppkey and m.l_returnflag = 'R')")
def composite_anti(t: Tables) -> DataFrame:
    returned = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_suppkey").distinct()
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey").join(returned, ["l_orderkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_linenumber")


@query("unnest_citations", "with w as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents) select w.doc_id, pos::int - 1 as pos, length(line)::bigint as chars, quality from w left join labels using (doc_id)")
def unnest_citations(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "pos", F.length("line").cast("long").alias("chars"), "quality")


@query("count_distinct_children", "select l_suppkey, count(distinct l_partkey)::bigint as parts, count(distinct l_orderkey)::bigint as orders from lineitem group by 1")
def count_distinct_children(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))


@query("counter_by_group", "select o_orderpriority, o_orderstatus, count(*)::bigint as n, sum(o_totalprice::decimal(18,2))::double as total from orders group by all")
def counter_by_group(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("collect_overlap", """with g as (select l_suppkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags, bool_or(l_returnflag in ('A', 'R')) as overlaps from lineitem group by 1) select * from g""")
def collect_overlap(t: Tables) -> DataFrame:
    sets = t.lineitem.groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    return sets.select("l_suppkey", F.array_join("f", ",").alias("flags"), F.arrays_overlap("f", F.array(F.lit("A"), F.lit("R"))).alias("overlaps"))


@query("dedupe_last_wins", "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1")
def dedupe_last_wins(t: Tables) -> DataFrame:
    return R.last_wins(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("dedupe_conflicts", "select user_id, count(distinct event_type)::bigint as values from events group by 1 having count(distinct event_type) > 1")
def dedupe_conflicts(t: Tables) -> DataFrame:
    return R.conflicts(t.events, "user_id", "event_type")


@query("dedupe_signature", "select source, sha256(lower(regexp_replace(text, '\\s+', ' ', 'g'))) as signature, min(doc_id) as doc_id from documents group by all")
def dedupe_signature(t: Tables) -> DataFrame:
    signed = t.documents.select("source", F.sha2(F.lower(F.regexp_replace("text", r"\s+", " ")), 256).alias("signature"), "doc_id")
    return R.first_wins(signed, ["source", "signature"], ["doc_id"])


@query("status_rollup", """with s as (select o_custkey, case o_orderstatus when 'F' then case when o_orderkey % 6 = 0 then 'FAILED' else 'SUCCESS' end when 'P' then 'RECOVERED' else 'SUCCESS' end as s from orders)
 select o_custkey, case when bool_and(s = 'FAILED') then 'FAILED' when bool_or(s in ('FAILED', 'PARTIAL')) then 'PARTIAL' when bool_or(s = 'RECOVERED') then 'RECOVERED' else 'SUCCESS' end as status from s group by 1""")
def status_rollup(t: Tables) -> DataFrame:
    status = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 6 == 0), "FAILED").when(F.col("o_orderstatus") == "P", "RECOVERED").otherwise("SUCCESS")
    return R.status_rollup(t.orders.select("o_custkey", status.alias("s")), "o_custkey", "s")


@query("header_disambiguation", "with h as (select p_size as tbl, p_partkey as col, case when p_partkey % 9 = 0 then ' ' else p_brand end as name from part), r as (select *, row_number() over (partition by tbl, name order by col) as n from h) select tbl, col, name, case when trim(name) = '' then 'column_' || col when n > 1 then name || ' [' || n || ']' else name end as header from r")
def header_disambiguation(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 9 == 0, " ").otherwise(F.col("p_brand"))
    return R.disambiguate(t.part.select(F.col("p_size").alias("tbl"), F.col("p_partkey").alias("col"), name.alias("name")), "tbl", "name", "col")


@query("lag_duplicate_text", "select conv_id, turn, role from (select *, lower(trim(text)) is not distinct from lag(lower(trim(text))) over w as rep, lag(turn) over w is null as first from conversations window w as (partition by conv_id order by turn)) where not rep or first")
def lag_duplicate_text(t: Tables) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn")
    told = F.lower(F.trim("text"))
    rows = t.conversations.select("conv_id", "turn", "role", told.eqNullSafe(F.lag(told).over(order)).alias("again"), F.lag("turn").over(order).isNull().alias("first"))
    return rows.where(~F.col("again") | F.col("first")).select("conv_id", "turn", "role")


@query("stratified_sample", "with g as (select o_orderpriority, dense_rank() over (order by o_orderpriority) - 1 as no from (select distinct o_orderpriority from orders)), r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderkey * 7919 % 100003, o_orderkey) as rn from orders) select o_orderkey, o_orderpriority from r join g using (o_orderpriority) where rn <= 52 // 5 + (no < 52 % 5)::int")
def stratified_sample(t: Tables) -> DataFrame:
    key = F.struct((F.col("o_orderkey") * 7919 % 100003), "o_orderkey")
    return R.stratified_sample(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", key, 52, 5)


@query("round_robin", "select o_orderkey, o_orderpriority, row_number() over (order by rn, o_orderpriority) as pick from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) as rn from orders) order by rn, o_orderpriority limit 23")
def round_robin(t: Tables) -> DataFrame:
    return R.round_robin(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 23)


@query("topk_latest", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by o_orderdate desc, o_orderkey limit 50")
def topk_latest(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("topk_sections", "select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey order by o_orderdate desc, o_orderkey, l_linenumber limit 500")
def topk_sections(t: Tables) -> DataFrame:
    joined = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.orderBy(F.desc("o_orderdate"), "o_orderkey", "l_linenumber").limit(500).select("o_orderkey", "l_linenumber")


@query("resume_from", "select event_id, user_id from events where event_id >= 9000")
def resume_from(t: Tables) -> DataFrame:
    return t.events.where(F.col("event_id") >= 9000).select("event_id", "user_id")


@query("recent_failures", "select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type = 'error') where rn <= 3")
def recent_failures(t: Tables) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.where("event_type = 'error'").withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("user_id", "event_id")


@query("set_ops", """with a as (select c_custkey as k from customer where c_acctbal > 0), b as (select distinct o_custkey as k from orders), r as (select 'intersect' as op, k from (select k from a intersect select k from b) union all select 'difference', k from (select k from a except select k from b) union all select 'union', k from (select k from a union select k from b)) select op, count(*)::bigint as n, sum(k)::bigint as s, min(k) as lo, max(k) as hi from r group by 1""")
def set_ops(t: Tables) -> DataFrame:
    a, b = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k"))
    parts = [("intersect", a.intersect(b)), ("difference", a.subtract(b)), ("union", a.union(b).distinct())]
    every = [p.withColumn("op", F.lit(n)) for n, p in parts]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("op").agg(F.count("*").alias("n"), F.sum("k").alias("s"), F.min("k").alias("lo"), F.max("k").alias("hi"))


@query("upsert_nodes", """with n as (select c_custkey, c_name, c_acctbal + 1 as c_acctbal from customer where c_custkey % 3 = 0 union all select c_custkey + 1000000, 'new', 0.0 from customer where c_custkey <= 5)
 select coalesce(n.c_custkey, c.c_custkey) as c_custkey, coalesce(n.c_name, c.c_name) as c_name, coalesce(n.c_acctbal, c.c_acctbal) as c_acctbal from customer c full join n on c.c_custkey = n.c_custkey""")
def upsert_nodes(t: Tables) -> DataFrame:
    from discloom.sources.sinks import upsert

    base = t.customer.select("c_custkey", "c_name", "c_acctbal")
    new = base.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    new = new.unionAll(base.where("c_custkey <= 5").select(F.col("c_custkey") + 1000000, F.lit("new"), F.lit(0.0)))
    return upsert(base, new, ["c_custkey"])


@query("replace_edges", "select o_custkey, o_orderkey from orders where o_custkey % 10 <> 0 union all select o_custkey, max(o_orderkey) from orders where o_custkey % 10 = 0 group by 1")
def replace_edges(t: Tables) -> DataFrame:
    from discloom.sources.sinks import replace_edges as replace

    edges = t.orders.select("o_custkey", "o_orderkey")
    return replace(edges, edges.where("o_custkey % 10 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")), ["o_custkey"])
