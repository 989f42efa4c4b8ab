"""Queries on search, profiles, packing, texts and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from discloom.functions import text as X
from discloom.operators import points as PT, profiling as P, projections as PR, search, validation as V
from discloom.plans.registry import Tables, query

_VECTOR = [round(((k * 37) % 17 - 8) / 10, 1) for k in range(64)]
_SQL_VECTOR = "[" + ", ".join(f"{x}::double" for x in _VECTOR) + "]"
_TOKENS = {"the": 1, "and": 2, "idiot": 9, "thnt": 3}
_DENSE = f"select vec_id as id, round(list_dot_product(embedding::double[], {_SQL_VECTOR}) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product({_SQL_VECTOR}, {_SQL_VECTOR}))), 9) as score from embeddings"
_SPARSE = f"""select doc_id as id, sum(w * case token {" ".join(f"when '{t}' then {w}" for t, w in _TOKENS.items())} end)::bigint as score from
 (select doc_id, token, count(*) as w from (select doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as token from documents) where token in ({", ".join(f"'{t}'" for t in _TOKENS)}) group by all) group by 1"""


@query("dense_topk", f"select id as vec_id, row_number() over (order by score desc, id) as rank from ({_DENSE}) order by rank limit 10")
def dense_topk(t: Tables) -> DataFrame:
    return search.dense_topk(t.embeddings, _VECTOR, 10, "vec_id", "embedding").select("vec_id", "rank")


@query("dense_topk_filtered", f"select id as vec_id, row_number() over (order by score desc, id) as rank from ({_DENSE} where label = 1) order by rank limit 5")
def dense_topk_filtered(t: Tables) -> DataFrame:
    return search.dense_topk(t.embeddings, _VECTOR, 5, "vec_id", "embedding", F.col("label") == 1).select("vec_id", "rank")


@query("dense_topk_many", """with q as (select vec_id as q, embedding::double[] as e from embeddings where vec_id % 100 = 0), s as (select q, vec_id, round(list_dot_product(embedding::double[], e), 9) as s from embeddings, q where vec_id <> q)
 select q, vec_id, rank from (select *, row_number() over (partition by q order by s desc, vec_id) as rank from s) where rank <= 5""")
def dense_topk_many(t: Tables) -> DataFrame:
    asked = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
    return search.dense_topk_many(t.embeddings, asked, 5, "vec_id", "embedding", "q", "e", most=100_000).select("q", "vec_id", "rank")


@query("sparse_topk", f"select id as doc_id, score, row_number() over (order by score desc, id) as rank from ({_SPARSE}) order by rank limit 20")
def sparse_topk(t: Tables) -> DataFrame:
    return search.sparse_topk(search.token_weights(t.documents, "doc_id", "text", _TOKENS), _TOKENS, 20, "doc_id")


@query("hybrid_rrf", f"""with d as (select id, row_number() over (order by score desc, id) as r from ({_DENSE}) order by r limit 50), s as (select id, row_number() over (order by score desc, id) as r from ({_SPARSE}) order by r limit 50),
 f as (select id, round(sum(1.0::double / (60 + r)), 9) as score from (select * from d union all select * from s) where id % 17 <> 0 group by 1) select id, row_number() over (order by score desc, id) as rank from f where score >= 0.012 order by rank limit 10""")
def hybrid_rrf(t: Tables) -> DataFrame:
    n = 10 * search.OVERFETCH
    dense = search.dense_topk(t.embeddings, _VECTOR, n, "vec_id", "embedding").withColumnRenamed("vec_id", "id")
    sparse = search.sparse_topk(search.token_weights(t.documents, "doc_id", "text", _TOKENS), _TOKENS, n, "doc_id").withColumnRenamed("doc_id", "id")
    seen = t.documents.where("doc_id % 17 = 0").select(F.col("doc_id").alias("id"))
    return search.fuse([dense, sparse], 10, "id", threshold=0.012, seen=seen).select("id", "rank")


# Cells that tell numbers, dates, years and percentages apart, dealt by part.
_MIXED = ("12 kg", "(3,000)", "5퍼센트", "▲1,234", "2024-05", "2024년 3월", "2023 Q4", "2101", "1899", "[7%]", "abc", "₩ 12,000", "1,2,3")
_LONG = f"""cells as (select p_size as tbl, unnest([0, 1, 2, 3, 4, 5]) as col, unnest([p_name, p_brand, p_type, p_retailprice::varchar,
 case when p_partkey % 10 = 0 then '' when p_partkey % 3 = 0 then '2024-01-0' || (p_partkey % 9 + 1) else '2024' end, [{", ".join(f"'{x}'" for x in _MIXED)}][p_partkey % {len(_MIXED)} + 1]]) as v from part)"""


def _cells(t: Tables) -> DataFrame:
    day = F.when(F.col("p_partkey") % 10 == 0, "").when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("2024-01-0"), (F.col("p_partkey") % 9 + 1).cast("string"))).otherwise("2024")
    mixed = F.element_at(F.array(*map(F.lit, _MIXED)), (F.col("p_partkey") % len(_MIXED) + 1).cast("int"))
    return t.part.select(F.col("p_size").alias("tbl"), F.posexplode(F.array("p_name", "p_brand", "p_type", F.col("p_retailprice").cast("string"), day, mixed)).alias("col", "v"))


_SIGNED, _DIGITS = r"[\(\[]?[+-△▲▼]?\s*", r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*"
_IS = {
    "numeric": rf"(?i)\s*{_SIGNED}[₩$€¥]?\s*{_DIGITS}(?:%|퍼센트|원|천원|백만원|억원|조원|주|개|명|건|톤|kg|g|km|m|㎡)?\s*[\)\]]?\s*",
    "date": r"\d{4}[-./]\d{1,2}(?:[-./]\d{1,2})?|\d{4}년(?:\s*\d{1,2}월(?:\s*\d{1,2}일)?)?|\d{8}|\d{4}\s*[Qq][1-4]", "year": r"(?:19|20|21)\d{2}", "percent": rf"(?i){_SIGNED}{_DIGITS}(?:%|퍼센트)\s*[\)\]]?",
}
_PROFILE = f"""with {_LONG}, f as (select tbl, col, trim(v) as v from cells where trim(v) <> ''), k as (select distinct tbl, col from cells),
 p as (select k.tbl, k.col, count(v) as non_empty, count(distinct v) as "distinct", {", ".join(f"round(coalesce(count(*) filter (where regexp_full_match(v, '{r}')) / nullif(count(v), 0), 0), 6) as {n}_ratio" for n, r in _IS.items())},
  round(coalesce(avg(length(v)), 0), 6) as avg_length, coalesce(max(length(v)), 0)::bigint as max_length from k left join f on k.tbl = f.tbl and k.col = f.col group by all)"""


@query("column_profile", f"{_PROFILE} select tbl, col::int as col, * exclude (tbl, col) from p")
def column_profile(t: Tables) -> DataFrame:
    return P.column_profile(_cells(t), ["tbl", "col"], "v")


_HEADERS = ("품목 코드", "구분", "상품", "단가", "기준일", "비중 ID")


@query("column_role", f"""{_PROFILE}, h as (select *, [{", ".join(f"'{h}'" for h in _HEADERS)}][col + 1] as header from p)
 select tbl, col::int as col, header, case when non_empty = 0 then 'other' when regexp_matches(header, '성명|이름|코드|번호|ID') and "distinct" / non_empty >= 0.45 and "distinct" >= 25 then 'identifier'
 when date_ratio >= 0.8 or (regexp_matches(header, '일자|날짜|기준일|변동일|연도|년월') and greatest(date_ratio, year_ratio) >= 0.4) then 'date' when numeric_ratio >= 0.8 or (regexp_matches(header, '금액|매출|수량|비중|율|단가|취득가액|증감') and numeric_ratio >= 0.4) then 'measure'
 when avg_length >= 50 then 'long_text' when regexp_matches(header, '구분|사업부문|제품|품목|지역|종류|회사|법인|계정과목') then 'dimension' when "distinct" / non_empty >= 0.9 and "distinct" >= 50 then 'identifier' else 'dimension' end as role from h""")
def column_role(t: Tables) -> DataFrame:
    header = F.element_at(F.array(*map(F.lit, _HEADERS)), F.col("col") + 1)
    profile = P.column_profile(_cells(t), ["tbl", "col"], "v").withColumn("header", header)
    return profile.select("tbl", "col", "header", P.column_role(F.col("header")).alias("role"))


@query("budgeted_values", f"""with {_LONG}, c as (select tbl, col::int as col, count(distinct v) as d from cells group by all), n as (select *, case when d <= 20 then d else 0 end as n from c), b as (select *, coalesce(sum(n) over (partition by tbl order by col rows between unbounded preceding and 1 preceding), 0) as before from n)
 select tbl, col, d, case when d > 20 then 'COLUMN_BUDGET' when before + n > 50 then 'TABLE_BUDGET' end as reason, (case when d <= 20 and before + n <= 50 then n else 0 end)::bigint as shown from b""")
def budgeted_values(t: Tables) -> DataFrame:
    return P.budgeted_values(_cells(t).groupBy("tbl", "col").agg(F.countDistinct("v").alias("d")), "tbl", "col", "d")


@query("table_strategy", """with f as (select doc_id, length(text) // 4 as tokens, len(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 50)) / greatest(1, len(string_split(text, chr(10)))) as r from documents)
 select doc_id, tokens::bigint as tokens, round(r, 6) as ratio, case when tokens <= 400 then 'WHOLE' when r >= 0.7 then 'ROW_GROUP' else 'DESCRIPTOR' end as strategy from f""")
def table_strategy(t: Tables) -> DataFrame:
    lines = F.split("text", "\n", -1)
    ratio = F.size(F.filter(lines, lambda x: F.length(x) >= 50)) / F.size(lines)
    rows = t.documents.select("doc_id", F.floor(F.length("text") / 4).cast("long").alias("tokens"), ratio.alias("r"))
    return rows.select("doc_id", "tokens", F.round("r", 6).alias("ratio"), P.embedding_strategy(F.col("tokens"), F.col("r"), 400, 0.7).alias("strategy"))


def _sized(t: Tables) -> DataFrame:
    size = F.length(F.concat_ws(" | ", "l_partkey", "l_suppkey", "l_shipdate")).cast("long")
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return t.lineitem.select("l_suppkey", F.row_number().over(order).cast("long").alias("pos"), size.alias("size"))


_SIZES = """z as (select l_suppkey, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_shipdate) as pos, length(l_partkey || ' | ' || l_suppkey || ' | ' || l_shipdate) as size from lineitem),
 n as (select l_suppkey, pos, size, row_number() over (partition by l_suppkey order by pos) as k, sum(size) over (partition by l_suppkey) + count(*) over (partition by l_suppkey) + 1 as whole from z)"""
_GREEDY = f"""with recursive {_SIZES}, w as (select l_suppkey, pos, k, size::bigint as total, 0 as chunk from n where k = 1
 union all select n.l_suppkey, n.pos, n.k, case when w.total + n.size > 1500 then n.size else w.total + n.size end, w.chunk + (w.total + n.size > 1500)::int from w join n on n.l_suppkey = w.l_suppkey and n.k = w.k + 1)
 select l_suppkey, pos, chunk::int as chunk_index, (max(chunk) over (partition by l_suppkey) + 1)::int as chunk_count from w"""


def _balanced(weight: str, capacity: int, own: str, more: str = "") -> str:
    """The fewest runs of at most `capacity`, found by hops along the longest runs; each is cut nearest to the mean of what is left."""
    return f"""with recursive {_SIZES}, t as (select l_suppkey, max(k) as last from n where {own} group by 1),
 s as (select l_suppkey, k, sum({weight}) over (partition by l_suppkey order by k)::bigint as upto from n where {own} union all select l_suppkey, 0, 0 from t),
 r as (select a.l_suppkey, a.k, max(b.k) as reach from s a join s b on a.l_suppkey = b.l_suppkey and b.k >= a.k and a.upto + {capacity} >= b.upto group by all),
 hop as (select l_suppkey, k, k as at, 0 as runs from s union all select hop.l_suppkey, hop.k, r.reach, hop.runs + 1 from hop join r on r.l_suppkey = hop.l_suppkey and r.k = hop.at where r.reach > hop.at),
 fewest as (select l_suppkey, k, max(runs) as runs from hop group by all),
 c as (select l_suppkey, 0::bigint as k, -1 as chunk from t union all
  select c.l_suppkey, (min(struct_pack(d := abs((b.upto - a.upto) - (e.upto - a.upto) / g.runs::double), m := -(b.upto - a.upto), k := b.k))).k, c.chunk + 1
  from c join t on t.l_suppkey = c.l_suppkey join s a on a.l_suppkey = c.l_suppkey and a.k = c.k join s e on e.l_suppkey = c.l_suppkey and e.k = t.last join fewest g on g.l_suppkey = c.l_suppkey and g.k = c.k
   join s b on b.l_suppkey = c.l_suppkey and b.k > c.k and b.upto - a.upto <= {capacity} join fewest h on h.l_suppkey = b.l_suppkey and h.k = b.k and h.runs <= g.runs - 1 where c.k < t.last group by c.l_suppkey, c.chunk),
 p as (select n.l_suppkey, n.pos, min(c.chunk)::int as chunk_index from n join c on c.l_suppkey = n.l_suppkey and c.k >= n.k group by all)
 select l_suppkey, pos, chunk_index, (max(chunk_index) over (partition by l_suppkey) + 1)::int as chunk_count{more and ", false as overflow"} from p{more}"""


#: Rows are far smaller than a chunk, so bytes are packed in balance wherever a table is over the soft limit, and none overflows.
_WHOLE = " union all select l_suppkey, pos, 0, 1, false from n where whole <= 4096"
for _how, _limit, _sql in (("greedy", 1500, _GREEDY), ("balanced", 1500, _balanced("size", 1500, "true")), ("bytes", 4096, _balanced("size + 1", 4095, "whole > 4096", _WHOLE))):

    @query({"greedy": "row_group_packing", "balanced": "balanced_packing", "bytes": "byte_chunks"}[_how], _sql)
    def _packed(t: Tables, how: str = _how, limit: int = _limit) -> DataFrame:
        return P.pack_tables(_sized(t), "l_suppkey", "pos", "size", how, limit)


@query("contextual_text", """select o_orderkey, concat_ws(chr(10) || chr(10), 'company: ' || trim(c_name), 'segment: ' || nullif(trim(c_mktsegment), ''), 'group: ' || o_orderpriority, 'date: ' || strftime(o_orderdate, '%Y-%m-%d')) as contextual_text,
 array_to_string([r_name, n_name, c_name], ' > ') as path from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""")
def contextual_text(t: Tables) -> DataFrame:
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")
    met = t.orders.join(own, F.col("o_custkey") == F.col("c_custkey"))
    text = X.context_text([("company", F.col("c_name")), ("segment", F.col("c_mktsegment")), ("group", F.col("o_orderpriority")), ("date", F.date_format("o_orderdate", "yyyy-MM-dd"))])
    return met.select("o_orderkey", text.alias("contextual_text"), X.path_text(F.array("r_name", "n_name", "c_name")).alias("path"))


@query("adjacent_dedupe", """with p as (select conv_id, list(role order by turn) as roles from conversations group by 1) select conv_id, array_to_string(list_filter(list_transform(range(1, len(roles) + 1), lambda i: case when i = 1 or roles[i] <> roles[i - 1] then roles[i] end), lambda x: x is not null), ' > ') as path from p""")
def adjacent_dedupe(t: Tables) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return t.conversations.groupBy("conv_id").agg(roles.alias("r")).select("conv_id", X.path_text(F.col("r")).alias("path"))


@query("fragment_validation", """with l as (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber) as n from lineitem), g as (select l_orderkey, min(l_linenumber) as lo, max(l_linenumber) as hi, count(distinct l_linenumber) as d, count(*) as n from lineitem where l_linenumber <> 4 or l_orderkey % 2 = 0 group by 1)
 select l_orderkey, l_linenumber, code from (select l_orderkey, l_linenumber, unnest(['BAD_QUANTITY', 'BAD_DISCOUNT', 'BAD_FLAG']) as code, unnest([l_quantity between 2 and 49, l_discount < 0.1, l_returnflag in ('A', 'N', 'R')]) as ok from lineitem) where not ok
 union all select l_orderkey, null, 'ORDER_NOT_DENSE' from g where lo <> 1 or hi - lo + 1 <> n or d <> n union all select l_orderkey, null, 'REPEATED_PART' from lineitem group by l_orderkey, l_partkey having count(*) > 1""")
def fragment_validation(t: Tables) -> DataFrame:
    rules = {"BAD_QUANTITY": F.col("l_quantity").between(2, 49), "BAD_DISCOUNT": F.col("l_discount") < 0.1, "BAD_FLAG": F.col("l_returnflag").isin("A", "N", "R")}
    rows = V.violations(t.lineitem, ["l_orderkey", "l_linenumber"], rules)
    gaps = V.dense_order(t.lineitem.where("l_linenumber <> 4 or l_orderkey % 2 = 0"), "l_orderkey", "l_linenumber", 1, "ORDER_NOT_DENSE")
    return V.all_violations([rows, gaps, V.unique_key(t.lineitem, ["l_orderkey", "l_partkey"], "REPEATED_PART").select("l_orderkey", "code")])


@query("snapshot_hash", """with h as (select source, sha256(doc_id || chr(31) || text) as h from documents), b as (select source, left(h, 4) as b, count(*) as n, sha256(string_agg(h, '' order by h)) as h from h group by all)
 select source, sum(n)::bigint as rows, sha256(string_agg(h, '' order by b)) as sha256 from b group by 1""")
def snapshot_hash(t: Tables) -> DataFrame:
    return V.snapshot(t.documents, "source", "doc_id", F.col("text"))


@query("record_probes", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, count(*) over (partition by o_custkey) as n from orders) where pos = 0 or pos = n // 2 or pos = n - 1")
def record_probes(t: Tables) -> DataFrame:
    return V.probes(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("duplicate_documents", "with n as (select doc_id, sha256(regexp_replace(text, '\\s+', '', 'g')) as h from documents) select a.doc_id, b.first from n a join (select h, min(doc_id) as first, count(*) as c from n group by 1) b on a.h = b.h where b.c > 1")
def duplicate_documents(t: Tables) -> DataFrame:
    """Documents alike but for whitespace, each with the first of its kind: no pairs of a group are listed."""
    signed = t.documents.select("doc_id", F.sha2(X.squeeze(F.col("text")), 256).alias("h"))
    groups = signed.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("h", "first")
    return signed.join(groups, "h").select("doc_id", "first")


@query("requested_fact_coverage", """with f as (select item_id, list_distinct(list_filter(regexp_extract_all(text, '[0-9A-Za-z가-힣]+'), lambda x: length(x) >= 2)) as tokens from benchmark), s as (select doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) as s from documents)
 select doc_id, item_id, bool_or(len(tokens) > 0 and len(list_filter(tokens, lambda x: contains(s, x))) = len(tokens)) as addressed from s, f group by all""")
def requested_fact_coverage(t: Tables) -> DataFrame:
    """Is there a sentence with all the tokens of a fact? Every benchmark item against every document."""
    return search.fact_coverage(t.documents, t.benchmark, "doc_id", "item_id")


@query("semantic_segments", """with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line from documents), c as (select *, trim(regexp_replace(line, '\\s+', ' ', 'g')) as t from l)
 select doc_id, pos::int as pos, case when regexp_matches(t, '^([(]?주\\s*\\d*[)]|※|\\*+|주석)') then 'NOTE' when regexp_matches(t, '^([<〈\\[【].*[>〉\\]】])$') then 'CAPTION' when length(t) <= 80 and regexp_matches(t, '^(제\\s*\\d+\\s*[장절조]|[IVX]+\\.|\\d+(\\.\\d+)*\\.|[가-하]\\.|[(]\\d+[)]|[①-⑳])\\s*\\S') then 'HEADING' else 'BODY' end as class from c where t <> ''""")
def semantic_segments(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where(X.collapse(F.col("line")) != "").select("doc_id", "pos", X.text_class(F.col("line")).alias("class"))


@query("identifiers", """select o_orderkey, 'd' || lpad(o_orderkey::varchar, 14, '0') || ':src0:s' || (o_custkey % 9) as section_id, 'd' || lpad(o_orderkey::varchar, 14, '0') as disclosure_id, left(sha256(o_orderkey || chr(31) || o_orderstatus), 16) as signature from orders""")
def identifiers(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("section:"), F.lpad(F.col("o_orderkey").cast("string"), 14, "0"), F.lit(":src0:s"), (F.col("o_custkey") % 9).cast("string"))
    own = t.orders.select("o_orderkey", X.disclosure_id(raw).alias("section_id"), "o_orderstatus")
    return own.select("o_orderkey", "section_id", X.parent_id(F.col("section_id"), 1).alias("disclosure_id"), X.short_signature(F.col("o_orderkey"), F.col("o_orderstatus")).alias("signature"))


@query("source_hash", "select l_orderkey, sha256(string_agg('f' || l_linenumber || chr(0) || sha256(l_returnflag || l_partkey) || chr(10), '' order by l_linenumber, sha256(l_returnflag || l_partkey))) as combined from lineitem group by 1")
def source_hash(t: Tables) -> DataFrame:
    """Hash over each source's ordered (path, sha256) pairs: an order's lines as its files."""
    path = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))
    return V.combined_hash(t.lineitem, "l_orderkey", path, F.concat("l_returnflag", F.col("l_partkey").cast("string")))


@query("kv_flatten", "select conv_id, turn, role || ' > turn ' || turn || ': ' || length(text) || chr(10) || 'turn: x' as lines from conversations")
def kv_flatten(t: Tables) -> DataFrame:
    """Fields to lines, each key path with its value."""
    path = F.array(F.concat(F.col("role"), F.lit(" ")), F.concat(F.lit("turn "), F.col("turn").cast("string")))
    field = lambda p, v: F.struct(F.array(p).alias("key_paths"), v.alias("raw_value"))
    fields = F.array(field(path, F.length("text").cast("string")), field(F.array(F.lit(" turn")), F.lit("x")))
    return t.conversations.select("conv_id", "turn", PT.field_lines(fields).alias("lines"))


@query("record_projection", "select o_custkey, json_object('columns', ['o_orderkey', 'o_orderstatus'], 'records', list([o_orderkey::varchar, o_orderstatus] order by o_orderkey))::varchar as canonical from orders group by 1")
def record_projection(t: Tables) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: F.array(x["o_orderkey"].cast("string"), x["o_orderstatus"]))
    grouped = t.orders.groupBy("o_custkey").agg(rows.alias("records"))
    return grouped.select("o_custkey", PR.canonical_table(["o_orderkey", "o_orderstatus"], F.col("records")).alias("canonical"))
