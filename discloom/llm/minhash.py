"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets and union-find grouping.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words between whitespace bytes); a
document of fewer words has its whole sequence as its one shingle. Documents with a Jaccard similarity of at
least 0.75 are linked, and the links' components are the groups.

SuperMinHash gives each element a pseudo-random permutation of the signature's places, element ranks 0, 1, 2...
being dealt to the places in that order, so an element's ranks are correlated and the estimate's variance is
lower than with independent hashes. Ranks are dealt here level by level: once every place of a signature holds a
value of an earlier level, later levels cannot lower it and the document stops.

Plan: one Python pass makes sketches; equal sets fold into their smallest doc_id (groupBy, partial first); band
keys of the representatives are grouped. In each bucket members are checked against a leader, the one that shares most
buckets with others, and in further rounds those apart from it against leaders of their own: a group of copies costs
one check for each member, and no bucket is ever gathered in a task. Pairs that still stand in different components of
a bucket are settled without listing them all. Call a shingle common if more than COMMON of these documents have it; let
c be the number of a document's common shingles, n of all. Two documents share at most min(c, c') common ones, so
they can reach the similarity only if they share a rare shingle, found by a join whose rows are at most COMMON
for each shingle of a document, or if min(c, c') alone suffices, a condition on sizes that copies of one text with
too many edits of their own don't meet. Both kinds are checked on full sets: no cap on candidates, none lost.

A pair at similarity 0.75 shares none of the 32 bands of four rows with probability 5e-6.

Edge cases: null or wordless texts have n_shingles 0 and are linked with nothing. Rows that share a doc_id are
one document: links of either count. A row without doc_id is never linked, has a null component_id and
kept = false. Empty tables give empty results. Columns besides doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from discloom.llm.common import bounded_batches, byte_view, few_files, materialise, slices
from discloom.llm.words import U, mix, shingle_sets

PLACES, ROWS = 128, 4
_EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Bytes of text sketched at once.
CHUNK = 1 << 19
#: Rounds of leaders before the remaining pairs are settled by their rare shingles.
LEADER_ROUNDS = 3
COMMON = 20
#: Up to so many candidate ids (16 bytes each) may be broadcast; beyond, texts are joined by shuffle.
BROADCAST_IDS = 1_000_000


def superminhash(sets: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures, one row for each set: level in the upper 32 bits, random value in the lower; all ones if empty."""
    rows = len(bounds) - 1
    signature = np.full(rows * places, _EMPTY)
    owner = np.repeat(np.arange(rows, dtype=np.int64), np.diff(bounds))
    element, perm = sets, None
    for level in range(places):
        if not len(element):
            break
        draw = mix(element, 16 + level)
        pick = level + (((draw & U(0xFFFFFFFF)) * U(places - level)) >> U(32)).astype(np.int64)
        if perm is None:
            place = pick
        else:
            at = np.arange(len(element))
            place = perm[at, pick].astype(np.int64)
            perm[at, pick] = perm[:, level]
        np.minimum.at(signature, owner * places + place, (U(level) << U(32)) | (draw >> U(32)))
        if level == places - 1:
            break
        open_rows = (signature.reshape(rows, places) == _EMPTY).any(axis=1)
        stay = open_rows[owner]
        if perm is None:
            element, owner, first = element[stay], owner[stay], pick[stay]
            perm = np.tile(np.arange(places, dtype=np.uint8 if places <= 256 else np.int32), (len(element), 1))
            perm[np.arange(len(element)), first] = 0
        elif stay.sum() < 0.8 * len(stay):
            element, owner, perm = element[stay], owner[stay], perm[stay]
    return signature.reshape(rows, places)


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of `rows` places; the band's number is part of it."""
    bands = signature.reshape(len(signature), -1, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands.shape[1], dtype=U), bands.shape[:2]).copy()
        for k in range(rows):
            key = mix(key, 7) * U(5) + bands[:, :, k]
    return mix(key, 8)


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate([[U(0)], np.cumsum(x, dtype=U)])
        return total[bounds[1:]] - total[bounds[:-1]]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        for a, b in slices(offsets, CHUNK):
            sets, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.diff(bounds)
            keys = band_keys(superminhash(sets, bounds))
            full = n > 0
            ends = np.concatenate([[0], np.cumsum(full * keys.shape[1])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(n), pa.array(_sums(mix(sets, 9), bounds).view(np.int64)), pa.array(_sums(mix(sets, 10), bounds).view(np.int64)), bands],
                ["doc_id", "n_shingles", "f1", "f2", "bands"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = byte_view(batch.column(1))
        for a, b in slices(offsets, CHUNK):
            sets, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["id", "shingles"])


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one partition: a star for each tree."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in list(parent)]
    yield pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["a", "b"], dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): local union-find, then large-star and small-star until stable.

    Each round's stars are written to the shared folder; only their count and a checksum come to the driver.
    """
    edges = materialise(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInPandas(_forest, "a long, b long"), "forest")
    known = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known or not state[0]:
            break
        known = state
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = materialise(few_files(small, 2 * state[0]), "stars")
    own = few_files(edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component"), state[0])
    return own.unionAll(own.select(F.col("component").alias("id"), "component").distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    met = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa").cast("long") + F.size("sb")).alias("sum"))
    return met.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def _mixed(buckets: DataFrame, grouped: DataFrame | None) -> DataFrame:
    """The members of buckets that span several components, with their component and whether it is theirs alone."""
    if grouped is None:
        return buckets.withColumns({"component": F.col("id"), "alone": F.lit(True)})
    now = buckets.join(grouped, "id", "left").withColumns({"component": F.coalesce("component", "id"), "alone": F.col("component").isNull()})
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return now.join(mixed, "key")


def _alike(percent: int) -> Column:
    """Sizes n and m that the similarity allows."""
    return 100 * F.least("n", "m") >= percent * F.greatest("n", "m")


def _leader_pairs(apart: DataFrame, percent: int) -> DataFrame:
    """(a, b): each bucket's members against its leader, outside the largest component if there is one.

    The leader shares most buckets with others among those that may lead: in a later round, members that are
    alone in their component so far, if a bucket has any.
    """
    degree = apart.groupBy("id").agg(F.sum("c").alias("degree"))
    rank = F.struct("alone", "degree", (-F.col("id")).alias("minus"), "n", "component")
    lead = apart.join(degree, "id").groupBy("key").agg(F.max(rank).alias("lead"))
    lead = lead.select("key", (-F.col("lead.minus")).alias("other"), F.col("lead.n").alias("m"), F.col("lead.component").alias("of"))
    met = apart.join(lead, "key").where(_alike(percent) & (F.col("component") != F.col("of")))
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _rare_pairs(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of different components and a common bucket that could reach the similarity.

    Sharing o rare shingles, a pair shares at most min(c, c') + o, of which similarity asks percent / (100 + percent) * (n + n').
    """
    own = apart.select("id", "n", "component").distinct()
    full = sets.join(own.select("id").distinct(), "id", "left_semi").select("id", F.explode("shingles").alias("s"))
    full = materialise(full, "shingles")
    spread = full.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    known = materialise(full.join(spread, "s"), "frequent")
    common = known.where(F.col("df") > COMMON).groupBy("id").agg(F.count("*").alias("c"))
    own = materialise(own.join(common, "id", "left").withColumn("c", F.coalesce("c", F.lit(0))), "own")
    rare = known.where(F.col("df") <= COMMON).select("id", "s").join(own, "id")
    there = rare.select("s", F.col("id").alias("other"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("component").alias("of"))
    enough = lambda o: (100 + percent) * (F.least("c", "d") + o) >= percent * (F.col("n") + F.col("m"))
    met = rare.join(there, "s").where((F.col("id") < F.col("other")) & (F.col("component") != F.col("of")) & _alike(percent))
    met = met.groupBy("id", "other", "n", "m", "c", "d").agg(F.count("*").alias("o")).where(enough(F.col("o")))
    placed = apart.select("key", "id").join(own, "id").where((100 + percent) * F.col("c") >= percent * (F.col("n") + F.ceil(F.col("n") * percent / 100)))
    # a pair that shares several buckets is met in the smallest of them alone
    keys = placed.groupBy("id").agg(F.collect_set("key").alias("keys"))
    placed = placed.join(keys, "id")
    beside = placed.select("key", F.col("id").alias("other"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("component").alias("of"), F.col("keys").alias("others"))
    once = F.col("key") == F.array_min(F.array_intersect("keys", "others"))
    near = placed.join(beside, "key").where((F.col("id") < F.col("other")) & (F.col("component") != F.col("of")) & _alike(percent) & enough(F.lit(0)) & once)
    return met.select(F.col("id").alias("a"), F.col("other").alias("b")).unionAll(near.select(F.col("id").alias("a"), F.col("other").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept: one row for each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = materialise(texts.mapInArrow(_sketch, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>"), "sketch")
    classes = materialise(sketch.where("n_shingles > 0 and doc_id is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    copies = classes.where("members > 1").select("f1", "f2", "n_shingles", "rep")
    seen = sketch.where("n_shingles > 0 and doc_id is not null")
    reps = seen.join(classes.select(F.col("rep").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"], "left_semi")
    placed = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    buckets = materialise(placed.join(shared, "key"), "buckets")
    members = materialise(buckets.select("id").distinct(), "members")
    wanted = members.withColumnRenamed("id", "doc_id")
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST_IDS else wanted
    sets = materialise(texts.where("doc_id is not null").join(wanted, "doc_id", "left_semi").mapInArrow(_full_sets, "id long, shingles array<long>"), "sets")
    links: list[DataFrame] = []
    grouped = None
    for step in range(LEADER_ROUNDS + 1):
        apart = materialise(_mixed(buckets, grouped), f"apart{step}")
        if apart.isEmpty():
            break
        pairs = _leader_pairs(apart, percent) if step < LEADER_ROUNDS else _rare_pairs(apart, sets, percent)
        links.append(materialise(_verified(pairs, sets, percent), f"links{step}"))
        grouped = materialise(components(reduce(DataFrame.unionAll, links)), f"grouped{step}")
        buckets = apart.drop("component", "alone")
    owner = sketch.join(copies, ["f1", "f2", "n_shingles"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("id"))
    if grouped is not None:
        owner = owner.join(grouped, "id", "left")
        component = F.coalesce("component", "id")
    else:
        component = F.col("id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return owner.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with their own columns; of rows that share a doc_id the one with the smallest text stays.

    Rows without doc_id or without words stay: they are linked with nothing.
    """
    found = materialise(near_duplicates(docs, percent=percent).select("doc_id", "kept").where("doc_id is not null"), "kept")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return left
    first = F.min_by(F.struct(*left.columns), F.struct(F.col("text").isNull(), "text", F.xxhash64(*[c for c, kind in left.dtypes if "map<" not in kind])))
    return left.where("doc_id is not null").groupBy(F.col("doc_id").alias("__of")).agg(first.alias("r")).select("r.*").unionByName(left.where("doc_id is null"))


#: Exact links by shared shingles, and the smallest doc_id that each document reaches.
ORACLE = r"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[k : k + least(5, len(w)) - 1], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as k from docs where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by 1
), hashed as (
  select doc_id, hash(s) as h from shingles
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as met from hashed a join hashed b on a.h = b.h and a.doc_id < b.doc_id group by all
), links as (
  select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * met >= 75 * (x.n + y.n - met)
), edges as (
  select a, b from links union all select b, a from links
), reach as (
  select doc_id as a, doc_id as b from docs union select r.a, e.b from reach r join edges e on r.b = e.a
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from docs d left join sizes s using (doc_id) join (select a, min(b) as c from reach group by 1) m on d.doc_id = m.a
"""
