"""Filters, joins, dedupes, chains and samples that the catalogue is made of."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def total_lookup(left: DataFrame, right: DataFrame, on: list[str], must: str) -> DataFrame:
    """Inner join that fails when a left row has no partner: `must` is a column of right that is never null."""
    met = left.join(right, on, "left")
    return met.withColumn(must, F.when(F.col(must).isNull(), F.raise_error(F.concat(F.lit("no match for "), F.to_json(F.struct(*on))))).otherwise(F.col(must)))


def missing_endpoints(edges: DataFrame, nodes: DataFrame, edge_col: str, node_col: str) -> DataFrame:
    return edges.join(nodes.select(F.col(node_col).alias(edge_col)), edge_col, "left_anti")


def last_wins(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    """The last row of each key by position, by an aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*position))
    return df.groupBy(*keys).agg(last.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: Sequence[str], position: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*position))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value; null counts as a value."""
    seen = F.countDistinct(value) + F.max(F.col(value).isNull().cast("int"))
    return df.groupBy(key).agg(seen.cast("long").alias("values")).where(F.col("values") > 1)


def status_rollup(df: DataFrame, key: str, status: str) -> DataFrame:
    """All FAILED: FAILED; any FAILED or PARTIAL: PARTIAL; any RECOVERED: RECOVERED; else SUCCESS."""
    s = F.col(status)
    out = df.groupBy(key).agg(F.bool_and(s == "FAILED").alias("all"), F.bool_or(s.isin("FAILED", "PARTIAL")).alias("some"), F.bool_or(s == "RECOVERED").alias("mended"))
    return out.select(key, F.when(F.col("all"), "FAILED").when(F.col("some"), "PARTIAL").when(F.col("mended"), "RECOVERED").otherwise("SUCCESS").alias("status"))


def correction_chain(corrections: DataFrame, root: str, receipt: str) -> DataFrame:
    """seq 1..n from the oldest, target (the one before, the root for the first) and is_latest, for each root."""
    order = Window.partitionBy(root).orderBy(receipt)
    return corrections.select(
        "*", F.row_number().over(order).cast("long").alias("seq"), F.coalesce(F.lag(receipt).over(order), F.col(root)).alias("target"), F.lead(receipt).over(order).isNull().alias("is_latest"),
    )


def latest_versions(documents: DataFrame, chain: DataFrame, key: str, root: str, receipt: str) -> DataFrame:
    """documents with is_latest: roots and corrections that a later correction replaces are not; others are."""
    last = chain.groupBy(root).agg(F.max(receipt).alias("_last"))
    gone = chain.select(F.col(receipt).alias("_doc"), root).unionAll(chain.select(F.col(root).alias("_doc"), root)).distinct().join(last, root).where(F.col("_doc") != F.col("_last"))
    gone = gone.select(F.col("_doc").alias(key)).distinct().withColumn("_gone", F.lit(True))
    return documents.join(gone, key, "left").withColumn("is_latest", F.col("_gone").isNull()).drop("_gone")


def latest_by_flag(documents: DataFrame, chain: DataFrame, key: str, root: str, receipt: str, flag: str = "is_latest_version") -> DataFrame:
    """documents with is_latest: the flag where every row has one, else as latest_versions() tells; a flag on some rows alone raises."""
    n, told = documents.agg(F.count("*"), F.count(flag)).first()
    if told == n and n:
        return documents.withColumn("is_latest", F.col(flag))
    if told:
        raise ValueError(f"{flag} stands on {told} of {n} rows: all or none must have it")
    return latest_versions(documents, chain, key, root, receipt)


def checked_scope(pilot: DataFrame, universe: DataFrame, key: str, name: str) -> DataFrame:
    """pilot, whose keys must all be in the universe under the same name; anything else raises."""
    known = universe.groupBy(F.col(key).alias("_key")).agg(F.max(name).alias("_name"))
    met = pilot.join(known, F.col(key) == F.col("_key"), "left")
    wrong = F.when(F.col("_key").isNull(), F.lit("missing from the universe: ")).when(~F.col(name).eqNullSafe(F.col("_name")), F.lit("another name in the universe: "))
    return met.withColumn(name, F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.col(key).cast("string")))).otherwise(F.col(name))).select(pilot.columns)


def relabelled(nodes: DataFrame, new: DataFrame, key: str, label: str, exclusive: Sequence[str]) -> DataFrame:
    """nodes with the labels of new's keys: of the exclusive labels a node has the new one alone, others stay. labels are an array."""
    told = new.groupBy(key).agg(F.max(label).alias("_label"))
    kept = F.filter("labels", lambda x: ~x.isin(*exclusive))
    met = nodes.join(told, key, "left")
    return met.withColumn("labels", F.when(F.col("_label").isNotNull(), F.array_union(kept, F.array("_label"))).otherwise(F.col("labels"))).drop("_label")


def longest_prefix(names: DataFrame, name: str, categories: DataFrame, prefix: str, row: str) -> DataFrame:
    """Each name with the category whose prefix is its longest; ties go to the smaller row; unmatched names have nulls.

    A distinct name meets its heads of every length that a prefix has by equality, so there is no cross join, and rows carry only names.
    """
    lengths = sorted(r[0] for r in categories.select(F.length(prefix)).distinct().collect())  # as many as prefixes are long
    known = categories.groupBy(F.col(prefix).alias("_head")).agg(F.min(row).alias("_row"))
    heads = names.select(name).distinct().select(name, F.explode(F.array_distinct(F.array(*[F.left(F.col(name), F.lit(n)) for n in lengths]))).alias("_head"))
    met = heads.join(known, "_head").groupBy(name).agg(F.max_by(F.struct("_head", "_row"), F.length("_head")).alias("_best"))
    return names.join(met, name, "left").select(*names.columns, F.col("_best._head").alias(prefix), F.col("_best._row").alias(row))


def closure(edges: DataFrame, child: str, parent: str, most: int = 64) -> DataFrame:
    """node, ancestor, depth of every pair that a path of edges joins: one equi-join for each level, until none is left.

    Paths longer than `most` raise: a cycle has no end.
    """
    own = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor"))
    up = own.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_next"))
    level, levels = own.withColumn("depth", F.lit(1)), []
    while not level.isEmpty():
        if len(levels) == most:
            raise ValueError(f"a path is longer than {most}")
        levels.append(level)
        level = level.join(up, "ancestor").select("node", F.col("_next").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
    return reduce(DataFrame.unionAll, levels) if levels else own.withColumn("depth", F.lit(1))


#: Days by group up to which their table is broadcast.
FEW_DAYS = 50_000
#: Stands for the number of a receipt without one: every numbered receipt comes before it.
_NO_NUMBER = 10**15


def resolve_corrections(sources: DataFrame, candidates: DataFrame) -> DataFrame:
    """The document that each correction corrects: a cascade in which uniqueness decides.

    sources: src (a key), receipt, original_date, doc_group, company, name, family. candidates: the same without
    original_date, with submitted. Stages: date and prior receipt, group (a missing side agrees), company (skipped without
    one), exact name, family, sole candidate. No source meets the candidates of its day: each bucket of (date, group, company,
    name or family), with * for what a source doesn't ask, is a row with its two smallest numbered receipts, enough to tell none,
    one and more prior ones apart. A source asks for its name, its family and its company, a join each; the first two stages
    only ask whether there is one. A first job counts days and groups: receipts without a number and candidates without a group have tables of their own, where there are any.
    """
    numbered = F.col("receipt").rlike(r"\A[0-9]{14}\z")
    is_ = lambda x: F.concat(F.lit("="), F.col(x).cast("string"))
    some, none, text = F.lit("*"), F.lit("-"), (lambda x: F.col(x).cast("string"))
    known = candidates.where("receipt is not null and submitted is not null").select(
        text("submitted").alias("d"), F.coalesce(is_("doc_group"), none).alias("g"), is_("company").alias("k"), text("name").alias("name"), text("family").alias("family"), "receipt", F.when(numbered, F.col("receipt").try_cast("long")).alias("r"),
    )
    days, loose, named = known.groupBy("d", "g").agg(F.max(F.col("r").isNull()).alias("named")).agg(F.count("*"), F.max(F.col("g") == none), F.max("named")).first()
    numbers = known.where("r is not null") if named else known
    pairs, own = {}, None
    for axis in ("name", "family"):
        kept = _least(_asked_ways(_least(numbers.select("d", "g", "k", F.col(axis).alias("x"), "r"))))
        pairs[axis], own = _pairs(kept), kept
    pairs["own"] = _pairs(_least(own.withColumn("x", F.lit(""))))
    lists = {}
    if named:
        for axis in ("name", "family", "own"):
            lists[axis] = _name_lists(_asked_ways(known.where("r is null").select("d", "g", "k", (F.lit("") if axis == "own" else F.col(axis)).alias("x"), "receipt")))

    met = sources.select(
        "src", text("original_date").alias("d"), F.coalesce(is_("doc_group"), some).alias("g"), F.coalesce(is_("company"), some).alias("k"), text("name").alias("name"), text("family").alias("family"), F.lit("").alias("own"),
        F.when(numbered, F.col("receipt").try_cast("long")).when(F.col("receipt").isNotNull(), F.lit(_NO_NUMBER)).alias("r"), *(["receipt"] if named else []),
    )
    met = met.withColumns({"code": F.when(F.col("d").isNull(), "NOT_RESOLVED"), "target": F.lit(None).cast("string")})
    sides = [F.col("g"), F.when(F.col("g") != some, none)][: 1 + bool(loose)]
    prior = lambda x: F.coalesce(F.col(x) < F.col("r"), F.lit(False)).cast("int")
    for axis, one in (("name", "EXACT"), ("family", "DOCUMENT_FAMILY_RECOVERED"), ("own", "UNIQUE_CANDIDATE_RECOVERED")):
        count, only = F.lit(0), []
        for side in sides:
            for table in (pairs[axis], lists.get(axis)):
                if table is None:
                    continue
                no = len(only)
                there = table.select(F.col("h").alias("_h"), *[F.col(x).alias(f"_{x}") for x in ("d", "g", "k", "x")], *[F.col(x).alias(f"_{x}{no}") for x in table.columns[5:]])
                keys = {"_h": "_ah", "_d": "d", "_g": "_ag", "_k": "k", "_x": axis}
                met = met.withColumn("_ag", side).withColumn("_ah", F.when(F.col("_ag").isNull() | F.col("d").isNull() | F.col(axis).isNull(), F.xxhash64("src")).otherwise(F.xxhash64("d", "_ag", "k", axis)))
                met = met.join(there, [F.col(x) == F.col(y) for x, y in keys.items()], "left").drop(*keys, "_ah", "_ag")
                if table is pairs[axis]:
                    count, first = count + prior(f"_r{no}") + prior(f"_then{no}"), F.when(prior(f"_r{no}") == 1, F.lpad(F.col(f"_r{no}").cast("string"), 14, "0"))
                else:
                    others = F.filter(f"_names{no}", lambda x: x != F.col("receipt"))
                    count, first = count + F.coalesce(F.size(F.coalesce(others, F.array().cast("array<string>"))), F.lit(0)), F.array_min(others)
                only.append(first)
        met = met.withColumn("_n", count).withColumn("target", F.when(F.col("code").isNull() & (F.col("_n") == 1), F.coalesce(*only)).otherwise(F.col("target")))
        met = met.withColumn("code", F.coalesce("code", F.when(F.col("_n") == 1, one).when(F.col("_n") > 1, "AMBIGUOUS")))
        met = met.select("src", "d", "g", "k", *[x for x in ("family", "own") if x in met.columns and x != axis], "r", *(["receipt"] if named else []), "code", "target")

    # the first two stages ask whether a prior receipt is there: the least number of a day tells, and the first and last of the rest
    ends = lambda df: df.agg(F.min("r").alias("r"), *([F.min("first").alias("first"), F.max("last").alias("last")] if named else []))
    by_group = ends(known.select("d", "g", "r", *([F.when(F.col("r").isNull(), F.col("receipt")).alias(x) for x in ("first", "last")] if named else [])).groupBy("d", "g"))
    seen = {}
    for what, side, table in [(f"_in_group{k}", x, by_group.unionByName(ends(by_group.groupBy("d")).withColumn("g", some))) for k, x in enumerate(sides)] + [("_in_day", None, ends(by_group.groupBy("d")))]:
        there = table.select(F.col("d").alias("_d"), *([F.col("g").alias("_g")] if side is not None else []), *[F.col(x).alias(f"_{x}") for x in table.columns if x not in ("d", "g")])
        keys = [F.col("d") == F.col("_d")] + ([side == F.col("_g")] if side is not None else [])
        met = met.join(F.broadcast(there) if days <= FEW_DAYS else there, keys, "left")
        found = prior("_r") == 1
        if named:
            found = found | F.coalesce(F.col("_first") != F.col("receipt"), F.lit(False)) | F.coalesce(F.col("_last") != F.col("receipt"), F.lit(False))
        met, seen[what] = met.withColumn(what, found).drop("_d", "_g", "_r", "_first", "_last"), F.col(what)
    in_group = reduce(Column.__or__, [v for k, v in seen.items() if k != "_in_day"])
    return met.select("src", F.coalesce("code", F.when(~F.col("_in_day"), "DATE_NOT_FOUND").when(~in_group, "GROUP_MISMATCH").otherwise("COMPANY_MISMATCH")).alias("code"), "target")


def _asked_ways(rows: DataFrame) -> DataFrame:
    """Each row for its own group and for *, and for its own company, where it has one, and for *."""
    for axis in ("g", "k"):
        rows = rows.withColumn(axis, F.explode(F.array_compact(F.array(axis, F.lit("*")))))
    return rows


#: A bucket's key. Its hash comes first: sorts then seldom compare the texts.
_BUCKET = ("h", "d", "g", "k", "x")


def _least(rows: DataFrame) -> DataFrame:
    """The two rows of each bucket with the smallest numbers; what a task drops is not shuffled."""
    hashed = rows.select(F.xxhash64("d", "g", "k", "x").alias("h"), "d", "g", "k", "x", "r")
    return hashed.withColumn("_i", F.row_number().over(Window.partitionBy(*_BUCKET).orderBy("r"))).where("_i <= 2")


def _pairs(least: DataFrame) -> DataFrame:
    """A row for each bucket: its smallest number and the one after it."""
    return least.withColumn("then", F.lead("r").over(Window.partitionBy(*_BUCKET).orderBy("r"))).where("_i = 1").drop("_i")


def _name_lists(rows: DataFrame) -> DataFrame:
    """A row for each bucket: its three smallest receipts without a number, each at most twice: two others stay when one is the asker's own."""
    hashed = rows.select(F.xxhash64("d", "g", "k", "x").alias("h"), "d", "g", "k", "x", "receipt")
    first = hashed.withColumn("_i", F.dense_rank().over(Window.partitionBy(*_BUCKET).orderBy("receipt"))).where("_i <= 3")
    twice = first.withColumn("_j", F.row_number().over(Window.partitionBy(*_BUCKET, "receipt").orderBy("_i"))).where("_j <= 2")
    return twice.groupBy(*_BUCKET).agg(F.collect_list("receipt").alias("names"))


def stratified_sample(df: DataFrame, group: str, key: Column, total: int, groups: int) -> DataFrame:
    """total rows, total // groups of each group and one more of the first total % groups, by the order of key."""
    order = F.dense_rank().over(Window.orderBy(group))
    numbered = df.select(group).distinct().withColumn("_no", order - 1)  # a row for each group
    quota = total // groups + (F.col("_no") < total % groups).cast("int")
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(key)))
    return ranked.where(F.col("_rank") <= total // groups + 1).join(numbered, group).where(F.col("_rank") <= quota).drop("_rank", "_no")


def round_robin(df: DataFrame, group: str, position: str, n: int) -> DataFrame:
    """The first n rows when groups are asked in turn, each in its own order; pick says when a row was taken."""
    turn = df.withColumn("_turn", F.row_number().over(Window.partitionBy(group).orderBy(position))).where(F.col("_turn") <= n)
    top = turn.orderBy("_turn", group).limit(n)
    return top.withColumn("pick", F.row_number().over(Window.orderBy("_turn", group)).cast("long")).drop("_turn")  # n rows


def disambiguate(df: DataFrame, table: str, name: str, column: str) -> DataFrame:
    """header: the nth repeat of a name becomes `name [n]`, a blank name column_i."""
    nth = F.row_number().over(Window.partitionBy(table, name).orderBy(column))
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    header = F.when(blank, F.concat(F.lit("column_"), F.col(column).cast("string"))).when(nth > 1, F.concat(F.col(name), F.lit(" ["), nth.cast("string"), F.lit("]"))).otherwise(F.col(name))
    return df.withColumn("header", header)


def widened_range(day: Column, low: Column, high: Column) -> Column:
    """low less a month to high plus a month, both included."""
    return day.between(F.add_months(low, -1), F.add_months(high, 1))
