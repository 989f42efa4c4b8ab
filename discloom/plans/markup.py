"""Queries on raw markup and late corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from discloom.operators import documents as D, projections as PR
from discloom.operators.relational import correction_chain
from discloom.plans.registry import Tables, query
from discloom.sources.sinks import answer_envelope
from discloom.streaming.events import apply_corrections


def _rendered(t: Tables) -> DataFrame:
    """Orders as filings: a table of lines with a two-row header, one row a line."""
    cells = F.concat_ws("", F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td>"), F.col("l_partkey").cast("string"), F.lit("</td><td>"), F.col("l_returnflag"), F.lit("</td></tr>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", cells.alias("c")))), lambda x: x["c"]), "")
    head = "<table><thead><tr><th rowspan=\"2\">line</th><th colspan=\"2\">item</th></tr><tr><th>part</th><th>flag</th></tr></thead><tbody>"
    return t.lineitem.groupBy("l_orderkey").agg(F.concat(F.lit(head), body, F.lit("</tbody></table>")).alias("html"))


@query("html_table_grid", "select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag) as n, 'line|item > part|item > flag' as headers, l_linenumber || '|' || l_partkey || '|' || l_returnflag as record from lineitem")
def html_table_grid(t: Tables) -> DataFrame:
    """Tables written from lineitem and parsed back: every record must return."""
    tables = D.table_rows(_rendered(t), "l_orderkey", "html")
    heads = F.array_join(F.transform("headers", lambda h: F.array_join(h, " > ")), "|")
    rows = tables.select("doc", heads.alias("headers"), F.explode("records").alias("r"))
    return rows.select("doc", (F.col("r.record_index") + 1).cast("long").alias("n"), "headers", F.array_join("r.values", "|").alias("record"))


@query("late_corrections", "with c as (select user_id as root, event_id as receipt from events where event_type = 'error') select root, receipt, row_number() over w as seq, coalesce(lag(receipt) over w, root) as target, lead(receipt) over w is null as is_latest from c window w as (partition by root order by receipt)")
def late_corrections(t: Tables) -> DataFrame:
    """Chains of the earlier corrections, then those that come late: the same as all at once."""
    every = t.events.where("event_type = 'error'").select(F.col("user_id").alias("root"), F.col("event_id").alias("receipt"))
    early = correction_chain(every.where("receipt % 3 <> 0"), "root", "receipt")
    return apply_corrections(early, every.where("receipt % 3 = 0"), "root", "receipt")


@query("kept_sections", "with s as (select conv_id, turn, -1 as parent, case when turn = 0 then 'ROOT' else 'HEADING' end as b from conversations where turn = 0 union all select conv_id, turn, turn - 1, 'HEADING' from conversations where turn > 0), r as (select *, max((b <> 'ROOT')::int) over (partition by conv_id) = 1 as real from s) select conv_id, turn, case when real and parent = 0 then -1 else parent end::bigint as parent, b as boundary from r where not (b = 'ROOT' and real)")
def kept_sections(t: Tables) -> DataFrame:
    """Turns as a chain of sections: the synthetic first one goes, its child becomes a root."""
    s = t.conversations.select("conv_id", "turn", F.when(F.col("turn") == 0, -1).otherwise(F.col("turn") - 1).cast("long").alias("parent"), F.when(F.col("turn") == 0, "ROOT").otherwise("HEADING").alias("boundary"))
    return PR.kept_sections(s, "conv_id", "turn", "parent", "boundary")


@query("keyed_records", "select l_orderkey, l_linenumber, 'part=' || l_partkey || ';part [2]=' || l_suppkey || ';column_2=' || l_returnflag as record from lineitem")
def keyed_records(t: Tables) -> DataFrame:
    heads = F.array(*[F.array(F.lit(h)) for h in ("part", "part", "")])
    record = PR.keyed_values(heads, F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag"))
    text = F.array_join(F.transform(F.map_entries(record), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return t.lineitem.select("l_orderkey", "l_linenumber", text.alias("record"))


@query("citations", "select o_orderkey, c_name || ', ' || o_orderpriority || ' (' || strftime(o_orderdate, '%Y-%m-%d') || '), ' || c_mktsegment || ' > ' || o_orderstatus as citation from orders join customer on o_custkey = c_custkey")
def citations(t: Tables) -> DataFrame:
    met = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return met.select("o_orderkey", PR.citation(F.col("c_name"), F.col("o_orderpriority"), F.col("o_orderdate"), F.array("c_mktsegment", "o_orderstatus")).alias("citation"))


@query("merged_references", "with r as (select l_orderkey, bool_and(not (l_linenumber = 5 and l_orderkey % 3 = 0)) as ok, count(distinct 's' || l_suppkey || ':e' || l_linenumber)::bigint as n from lineitem group by 1) select l_orderkey, case when ok then n else 0 end::bigint as n_references from r")
def merged_references(t: Tables) -> DataFrame:
    lost = (F.col("l_linenumber") == 5) & (F.col("l_orderkey") % 3 == 0)
    section = F.when(~lost, F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    rows = t.lineitem.select("l_orderkey", F.concat(F.lit("d"), F.col("l_orderkey").cast("string")).alias("d"), section.alias("s"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("e"), F.col("l_linenumber").alias("p"))
    return PR.references_or_nothing(rows, "l_orderkey", "d", "s", "e", "p").select("l_orderkey", F.size("source_references").cast("long").alias("n_references"))


@query("answer_envelopes", "select o_orderkey, json_object('question_id', 'q' || o_orderkey, 'question', o_orderpriority, 'retrieved_context', null, 'think_trace', o_orderstatus, 'answer', case when o_orderstatus = 'F' then 'done' end)::varchar as envelope from orders")
def answer_envelopes(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("q"), "o_orderpriority", F.lit(None).cast("string").alias("c"), "o_orderstatus", F.when(F.col("o_orderstatus") == "F", "done").alias("a"))
    return rows.select("o_orderkey", answer_envelope("q", "o_orderpriority", "c", "o_orderstatus", "a").alias("envelope"))
