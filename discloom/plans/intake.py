"""Queries that read files, streams and plans: what is written from a table must come back as SQL tells it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from discloom.operators import points as PT, relational as R
from discloom.plans import scope as SC
from discloom.plans.registry import Tables, query
from discloom.session import scratch
from discloom.sources import readers, sinks
from discloom.streaming import events as E

_ROW = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("s", T.StringType())])


def _lines(t: Tables) -> DataFrame:
    """Orders as JSON lines; every seventh is torn, every eighth blank, every ninth an array."""
    key = F.col("o_orderkey")
    whole = F.to_json(F.struct(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("k"), key.alias("v"), F.col("o_orderstatus").alias("s")))
    line = F.when(key % 7 == 0, F.left(whole, F.lit(9))).when(key % 8 == 0, " ").when(key % 9 == 0, "[1, 2]").otherwise(whole)
    return t.orders.select(line.alias("value"), key.alias("o_orderkey"))


@query("jsonl_rows", "select 'c' || o_custkey as k, o_orderkey as v, o_orderstatus as s from orders where o_orderkey % 7 <> 0 and o_orderkey % 8 <> 0 and o_orderkey % 9 <> 0")
def jsonl_rows(t: Tables) -> DataFrame:
    """Written as text and read leniently: lines that are no objects are left out."""
    path = scratch(t.spark, "lines")
    _lines(t).select("value").write.text(path)
    return readers.read_jsonl(t.spark, path, _ROW)


@query("jsonl_keyed", "select 'c' || o_custkey as k, max(o_orderkey) as v, max_by(o_orderstatus, o_orderkey) as s from orders where o_orderkey % 7 <> 0 and o_orderkey % 8 <> 0 and o_orderkey % 9 <> 0 group by o_custkey")
def jsonl_keyed(t: Tables) -> DataFrame:
    """The last line of each key, over the files of a range-sorted table."""
    path = scratch(t.spark, "keyed")
    _lines(t).repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").select("value").write.text(path)
    return readers.read_keyed_jsonl(t.spark, path, _ROW, "k")


_MASTER = "select c_custkey::varchar as corp_code, c_name as corp_name, case when c_custkey % 3 <> 0 then c_mktsegment end as market, case when c_custkey % 4 <> 0 then c_custkey * 1000 end::bigint as market_cap from customer"


@query("company_master", _MASTER)
def company_master(t: Tables) -> DataFrame:
    """The customers as a master file and back: blanks are null, grouped numbers whole, the count is checked."""
    path, key = scratch(t.spark, "master"), F.col("c_custkey")
    told = {"corp_code": key.cast("string"), "corp_name": F.col("c_name"), "market": F.when(key % 3 == 0, " ").otherwise(F.col("c_mktsegment")), "market_cap": F.when(key % 4 == 0, "").otherwise(F.format_number(key * 1000, 0))}
    t.customer.select(*[told.get(c, F.lit("x")).alias(c) for c in readers.COMPANY_FIELDS]).write.option("header", True).csv(path)
    return readers.read_companies(t.spark, path, t.customer.count()).select("corp_code", "corp_name", "market", "market_cap")


@query("universe_table", "select c_custkey::varchar as corp_code, c_name as corp_name from customer")
def universe_table(t: Tables) -> DataFrame:
    path = scratch(t.spark, "universe")
    t.customer.select(F.col("c_custkey").alias("corp_code"), F.col("c_name").alias("corp_name")).write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_universe(t.spark, path)


@query("rewritten_partitions", "select o_orderstatus, o_orderkey, case when o_orderstatus = 'F' then 'second' else 'first' end as run from orders where o_orderstatus <> 'F' or o_orderkey % 2 = 0")
def rewritten_partitions(t: Tables) -> DataFrame:
    """A second run writes one partition anew: what the first had there goes, the others stay."""
    path = scratch(t.spark, "partitions")
    rows = t.orders.select("o_orderstatus", "o_orderkey")
    sinks.write_partitioned(rows.withColumn("run", F.lit("first")), path, ["o_orderstatus"])
    sinks.write_partitioned(rows.where("o_orderstatus = 'F' and o_orderkey % 2 = 0").withColumn("run", F.lit("second")), path, ["o_orderstatus"])
    return t.spark.read.parquet(path)


@query("written_lines", "select o_orderkey, o_orderstatus, case when o_orderkey % 2 = 0 then o_orderpriority end as priority from orders")
def written_lines(t: Tables) -> DataFrame:
    """JSON lines keep their nulls."""
    path = scratch(t.spark, "json")
    sinks.write_jsonl(t.orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("priority")), path)
    return t.spark.read.schema("o_orderkey bigint, o_orderstatus string, priority string").json(path)


@query("streamed_latest", "select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type from events group by 1")
def streamed_latest(t: Tables) -> DataFrame:
    """The events as a stream of files, the last event of each user kept: the same as over the whole table."""
    path = scratch(t.spark, "stream")
    t.events.repartition(4, "event_id").write.parquet(f"{path}/in")
    E.keep_latest(E.read_events(t.spark, f"{path}/in", 2), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return E.latest(t.spark, f"{path}/out").select("user_id", "event_id", "event_type")


@query("rebuilt_rows", "select o_orderkey from orders where o_orderkey % 5 = 0 or o_orderkey % 6 = 0 or o_orderkey % 7 = 0")
def rebuilt_rows(t: Tables) -> DataFrame:
    """Rows to build anew: their digest or builder changed, or they weren't there before."""
    key = F.col("o_orderkey")
    current = t.orders.select(key, F.sha2("o_orderpriority", 256).alias("digest"), F.lit("v2").alias("version"))
    previous = current.where(key % 5 != 0).select(key, F.when(key % 6 == 0, "old").otherwise(F.col("digest")).alias("digest"), F.when(key % 7 == 0, "v1").otherwise(F.col("version")).alias("version"))
    return readers.reusable(previous, current, ["o_orderkey"], "digest", "version").select("o_orderkey")


@query("checked_scope", "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def checked_scope(t: Tables) -> DataFrame:
    universe = t.customer.select("c_custkey", "c_name")
    return R.checked_scope(t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name"), universe, "c_custkey", "c_name")


@query("embedded_points", "select doc_id, length(text)::double as width, (length(text) % 7)::double as rest from documents where text is not null")
def embedded_points(t: Tables) -> DataFrame:
    """Each distinct text meets the model once, in batches of like length, and its vector goes to all that have it."""
    points = t.documents.where("text is not null").select("doc_id", F.col("text").alias("contextual_text"), F.sha2("text", 256).alias("text_hash"))
    found = PT.embed_once(points, lambda texts: [[float(len(x)), float(len(x) % 7)] for x in texts])
    return found.select("doc_id", F.col("vector")[0].cast("double").alias("width"), F.col("vector")[1].cast("double").alias("rest"))


@query("token_counts", "select doc_id, ceil(octet_length(encode(text)) / 3)::bigint as tokens from documents")
def token_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", PT.approximate_tokens(F.col("text")).alias("tokens"))


@query("point_faults", """select 'orphan_record' as code, 't' || o_orderkey as id from orders where o_orderkey % 10 = 3 union all select 'duplicate_point_id', 'p' || (o_orderkey - 1) from orders where o_orderkey % 10 = 5 and exists (select 1 from orders o where o.o_orderkey = orders.o_orderkey - 1)""")
def point_faults(t: Tables) -> DataFrame:
    """Some records name tables that no evidence has, some points the id of the one before."""
    key = F.col("o_orderkey")
    table = lambda lost: F.when(~lost, F.concat(F.lit("t"), key.cast("string")))
    evidence = t.orders.select(key.alias("doc"), table(key % 10 == 3).alias("table_id"))
    records = t.orders.select(key.alias("doc"), table(F.lit(False)).alias("table_id"))
    points = t.orders.select(F.concat(F.lit("p"), F.when(key % 10 == 5, key - 1).otherwise(key).cast("string")).alias("point_id"))
    return PT.point_faults(evidence, records, points)


_LEVEL_ROWS = "(values ('SECTION', 3), ('DISCLOSURE', 5), ('COMPANY', 8), ('GLOBAL', 10)) l(level, base)"


@query("result_limits", f"""select level, intent, previous, expand, ids, case when ids > 0 then ids when expand and previous > 0 then least(20, previous + 5) else base + case when intent in ('COMPARISON', 'TREND', 'HISTORY') then 5 else 0 end end::bigint as n
 from {_LEVEL_ROWS}, (values ('FACT'), ('COMPARISON'), ('TREND'), ('HISTORY')) i(intent), (values (0), (3), (12), (18)) p(previous), (values (true), (false)) e(expand), (values (0), (7)) d(ids)""")
def result_limits(t: Tables) -> DataFrame:
    """How many results a question asks for, for every kind of question."""
    asked = [(level, intent, previous, expand, ids) for level in SC.LEVELS for intent in ("FACT", "COMPARISON", "TREND", "HISTORY") for previous in (0, 3, 12, 18) for expand in (True, False) for ids in (0, 7)]
    rows = [(*a, SC.result_limit(a[0], [a[1]], [a[2]] if a[2] else [], a[3], a[4])) for a in asked]
    return t.spark.createDataFrame(rows, "level string, intent string, previous int, expand boolean, ids int, n long")


@query("plan_checks", """select * from (values ('amount', 'refused'), ('amount of issuer', 'refused'), ('amount of issuer in period', 'taken'), ('count', 'taken'), ('repeated', 'refused'), ('unknown', 'refused'), ('failed', 'refused'),
 ('complete without any', 'refused'), ('partial without any', 'taken'), ('good', 'taken'), ('range', 'refused'), ('two ways', 'refused'), ('twice', 'refused'), ('same filters', 'taken'), ('other filters', 'refused')) v(plan, outcome)""")
def plan_checks(t: Tables) -> DataFrame:
    """Plans that must not run are refused before any data is read; filters are the same in any order."""
    known = {"a": "SUCCESS", "b": "ERROR"}
    x, y = SC.Filter("x", match=1), SC.Filter("y", any_of=(3, 2))

    def same(left: list, right: list) -> None:
        if SC.signature(left) != SC.signature(right):
            raise SC.PlanError("another question")

    checks = {
        "amount": lambda: SC.check_clear(["AMOUNT"], [], []), "amount of issuer": lambda: SC.check_clear(["AMOUNT"], ["A"], []), "amount of issuer in period": lambda: SC.check_clear(["AMOUNT"], ["A"], ["2024"]), "count": lambda: SC.check_clear(["COUNT"], [], []),
        "repeated": lambda: SC.check_selection("COMPLETE", ["a", "a"], known), "unknown": lambda: SC.check_selection("COMPLETE", ["z"], known), "failed": lambda: SC.check_selection("PARTIAL", ["b"], known),
        "complete without any": lambda: SC.check_selection("COMPLETE", [], known), "partial without any": lambda: SC.check_selection("PARTIAL", [], known), "good": lambda: SC.check_selection("COMPLETE", ["a"], known),
        "range": lambda: SC.Filter("x", match=1, bounds={"gte": 1}), "two ways": lambda: SC.Filter("x", match=1, any_of=(1,)), "twice": lambda: SC.conjunction([x, SC.Filter("x", match=2)]),
        "same filters": lambda: same([x, y], [SC.Filter("y", any_of=(2, 3)), x]), "other filters": lambda: same([x], [y]),
    }
    rows = []
    for plan, check in checks.items():
        try:
            check()
            rows.append((plan, "taken"))
        except SC.PlanError:
            rows.append((plan, "refused"))
    return t.spark.createDataFrame(rows, "plan string, outcome string")
