"""Line dedup by site-relative frequency, in DataFrame functions only.

Documents are grouped by host; for each distinct line the documents of the host that contain it are divided by
the host's documents, and a line whose ratio exceeds `max_ratio` is boilerplate there and dropped wherever it
stands on that host. Lines are compared without surrounding spaces, tabs and carriage returns.

Plan: each document's distinct line hashes (xxhash64) are exploded and counted by (host, line) with partial
aggregation, so a hot host's common lines shrink before the shuffle and no window or list over a host exists. The
host's own count rides along as a row with a null line. The boilerplate that is left, at most the mean number of
lines of a document divided by max_ratio for each host, is written as one array for each host; whether that
small table is broadcast or joined by shuffle (with skewed hosts split) is the planner's choice by its size.

Edge cases: null text stays null with n_lines 0; blank lines are kept and never counted; a line repeated within a
document counts once; a null host is a host of its own, as is the empty one. A line needs `min_docs` documents
to be dropped, so small hosts are left alone. All documents stay, some perhaps with empty text. Two lines of one
hash would share their fate: with h hosts' boilerplate lines b in all, a line is lost so with probability
b / 2**64. Columns other than host and text are carried unchanged; clashing names cannot occur, since the
operator's own columns are dropped or named by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from discloom.llm.common import materialise

MAX_RATIO = 0.08
MIN_DOCS = 3

_HOST, _LINE, _SET = "__line_dedup_host", "__line_dedup_line", "__line_dedup_set"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, sorted line hashes) of each host that has boilerplate lines."""
    keys = F.array_distinct(F.transform(F.filter(F.transform(_lines(text), _key), lambda x: x != ""), lambda x: F.xxhash64(x)))
    keys = F.concat(F.array(F.lit(None).cast("bigint")), F.coalesce(keys, F.array().cast("array<bigint>")))
    counts = docs.select(host.alias(_HOST), F.explode(keys).alias(_LINE)).groupBy(_HOST, _LINE).agg(F.count("*").alias("n"))
    counts = materialise(counts.where((F.col("n") >= min_docs) | F.col(_LINE).isNull()), "line-counts")
    totals = counts.where(F.col(_LINE).isNull()).select(F.col(_HOST).alias("host"), F.col("n").alias("of"))
    met = counts.where(F.col(_LINE).isNotNull()).join(totals, F.col(_HOST).eqNullSafe(F.col("host")))
    return met.where(F.col("n") > max_ratio * F.col("of")).groupBy(_HOST).agg(F.array_sort(F.collect_list(_LINE)).alias(_SET))


def dedup_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_docs: int = MIN_DOCS, counts: bool = False) -> DataFrame:
    """docs with boilerplate lines dropped from the text; counts: also n_lines and n_dropped (they replace such columns)."""
    sets = materialise(boilerplate(docs, F.col(host_col), F.col(text_col), max_ratio, min_docs).withColumnRenamed(_HOST, "__line_dedup_of"), "boilerplate")
    joined = docs.join(sets, F.col(host_col).eqNullSafe(F.col("__line_dedup_of")), "left")
    text, found = F.col(text_col), F.col(_SET)
    kept = F.filter(_lines(text), lambda x: (_key(x) == "") | ~F.array_contains(found, F.xxhash64(_key(x))))
    cleaned = F.when(found.isNull(), text).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns if not (counts and c in ("n_lines", "n_dropped"))]
    if counts:
        n = F.when(text.isNull(), 0).otherwise(F.size(_lines(text))).cast("long")
        lost = F.when(found.isNull() | text.isNull(), 0).otherwise(F.size(_lines(text)) - F.size(kept)).cast("long")
        columns += [n.alias("n_lines"), lost.alias("n_dropped")]
    return joined.select(columns)


ORACLE = f"""
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line from documents
), keyed as (
  select distinct doc_id, source, trim(line, ' ' || chr(9) || chr(13)) as line from lines
), totals as (
  select source, count(*) as pages from documents group by source
), counts as (
  select source, line, count(*) as n from keyed where line <> '' group by source, line
), bad as (
  select c.source, c.line from counts c join totals t on c.source is not distinct from t.source
  where c.n >= {MIN_DOCS} and c.n > {MAX_RATIO} * t.pages
), numbered as (
  select d.doc_id, d.source, u.i as i, string_split(d.text, chr(10))[u.i] as line
  from documents d, lateral (select unnest(range(1, len(string_split(d.text, chr(10))) + 1)) as i) u
), flagged as (
  select n.*, b.line is not null as dropped from numbered n
  left join bad b on n.source is not distinct from b.source and trim(n.line, ' ' || chr(9) || chr(13)) = b.line
)
select d.doc_id, d.source,
  case when d.text is null then null else coalesce((select string_agg(f.line, chr(10) order by f.i) from flagged f where f.doc_id = d.doc_id and not f.dropped), '') end as text,
  coalesce(s.n_lines, 0)::bigint as n_lines, coalesce(s.n_dropped, 0)::bigint as n_dropped
from documents d left join (
  select doc_id, count(*) as n_lines, sum(dropped::int) as n_dropped from flagged group by doc_id
) s using (doc_id)
"""
