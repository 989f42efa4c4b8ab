"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Sources in code point order (null last) weigh 5, 2, 1, repeating, unless told otherwise, and share the size of
the whole corpus. A target stops at three times its source's size; what it cannot take is shared again by weight.

Schedule: slot k has the point frac((k + 0.5) / golden ratio); points are mapped through the cumulative targets, so
every prefix of the slots holds the sources near their shares. Slots are ranked within their source. Each
source's documents, shuffled by a seeded hash, form a stream that repeats up to three times; its target is cut
into equal-token blocks, one for each of its slots, and block r goes to the source's slot of rank r. A source
whose interval no point meets gets one slot after the others. Targets are met to the word, whatever the size.

Plan: sizes are counted in one scan and written with the source and hash. Every place in an order (sources by name and
by need, cumulative targets, a point's interval, a slot's rank, a document's place in its source's stream) is a prefix sum
of two levels: ranges or hash prefixes, whose number grows with the rows, and rows within one. No window holds a whole
source, nor all sources or slots, and there is no cross join. Slots grow with the corpus, one for BLOCK_WORDS words.

Edge cases: null texts have size 0; sources of size 0 have target 0 and take nothing; repeated rows are
documents of their own; a null doc_id is carried; a very long text takes several blocks. Empty tables give empty results.
Reruns agree: the hash covers doc_id and text, ties are broken by doc_id and size, and rows alike in all of these are
interchangeable. mix() doesn't look at other columns; mix_documents() carries all, before its own, which replace
columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from discloom.llm.common import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 8192
#: Rows of a range or bucket of a prefix sum, about.
GROUP_ROWS = 1 << 16
SEED = 20240229
GOLDEN = 0.6180339887498949

_FIRST = Window.unboundedPreceding
_BEFORE = (_FIRST, -1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """df with a column for each of `sums`: the sum over all rows that come before in `order`.

    Rows are dealt to ranges and summed there; only a row for each range passes through one window.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), label)
    whole = parts.groupBy("__range").agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    line = Window.orderBy("__range").rowsBetween(*_BEFORE)
    base = whole.select("__range", *[F.coalesce(F.sum(name).over(line), F.lit(0)).alias(f"__{name}") for name in sums])
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(*_BEFORE)
    inside = parts.withColumns({name: F.coalesce(F.sum(x).over(own), F.lit(0)) for name, x in sums.items()}).join(base, "__range")
    return inside.select(*df.columns, *[(F.col(name) + F.col(f"__{name}")).cast("long").alias(name) for name in sums])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source_no, source, source_size, docs, target: one row for each source.

    With caps c and weights w the targets are min(c, level * w); sorted by c / w, sources fill up one after another, and
    level is the first (total - caps before) / (weights from here on) that its source's c / w isn't below.
    """
    name = F.col("source").asc_nulls_last()
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    own = running(own, [name], {"source_no": F.lit(1)}, "sources")
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
    own = own.withColumn("cap", F.col("source_size") * most).withColumn("turn", F.col("cap") / F.col("weight"))
    own = materialise(running(own, [F.col("turn"), name], {"spent": F.col("cap"), "gone": F.col("weight")}, "turns"), "filled")
    total, every = own.agg(F.sum("source_size"), F.sum("weight")).first()
    own = own.withColumn("level", (F.lit(total or 0) - F.col("spent")) / (F.lit(every or 1) - F.col("gone")))
    level = own.where("level <= turn").agg(F.max("level")).first()[0] or 0.0
    return own.select("source_no", "source", "source_size", "docs", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _slots(plan: DataFrame, slots: int) -> DataFrame:
    """source_no, rank, slot: the schedule's slots, ranked within their source."""
    spark = plan.sparkSession
    live = plan.where("target_words > 0").select("source_no", "target_words")
    words = live.agg(F.sum("target_words")).first()[0] or 1
    # each interval's start stands among the points; a point belongs to the last start before it
    starts = running(live, [F.col("source_no")], {"before": F.col("target_words")}, "intervals").select((F.col("before") / F.lit(words)).alias("x"), "source_no", F.lit(None).cast("long").alias("slot"))
    points = spark.range(slots).select(F.pmod((F.col("id") + 0.5) * GOLDEN, F.lit(1.0)).alias("x"), F.lit(None).cast("long").alias("source_no"), F.col("id").alias("slot"))
    marks = materialise(starts.unionAll(points).repartitionByRange("x").withColumn("range", F.spark_partition_id()), "marks")
    lasts = marks.groupBy("range").agg(F.max_by("source_no", F.when(F.col("source_no").isNotNull(), F.struct("x", "source_no"))).alias("last"))
    lasts = lasts.select("range", F.last("last", ignorenulls=True).over(Window.orderBy("range").rowsBetween(*_BEFORE)).alias("carried"))
    here = F.last("source_no", ignorenulls=True).over(Window.partitionBy("range").orderBy("x", F.col("slot").asc_nulls_first(), "source_no").rowsBetween(_FIRST, 0))
    met = marks.withColumn("here", here).join(lasts, "range").where("slot is not null").select(F.coalesce("here", "carried").alias("source_no"), "slot").where("source_no is not null")
    met = materialise(met, "met")
    unmet = live.join(met.select("source_no").distinct(), "source_no", "left_anti").select("source_no", (F.lit(slots) + F.col("source_no")).alias("slot"))
    every = met.unionByName(unmet).withColumn("group", F.floor(F.col("slot") / GROUP_ROWS))
    counts = every.groupBy("source_no", "group").agg(F.count("*").alias("n"))
    base = counts.select("source_no", "group", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("group").rowsBetween(*_BEFORE)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("source_no", "group").orderBy("slot")) - 1
    return every.withColumn("rank", rank).join(base, ["source_no", "group"]).select("source_no", "slot", (F.col("rank") + F.col("base")).cast("long").alias("rank"))


def schedule(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", block_words: int = BLOCK_WORDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(slots, placed). slots: slot, doc_id, source_no, start, from_word, to_word: the words of a document that the slot takes.

    placed: doc_id, source, size, source_size, target, source_no, start (its place in its source's stream) and the columns `keep` of every document.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)).alias("h"), *keep)
    sized = materialise(sized, "sized")
    plan = materialise(targets(sized).withColumn("target_words", F.floor("target").cast("long")), "targets")
    n, rows, words = plan.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    turns = materialise(_slots(plan, max(1, 16 * n, -(-int(words) // block_words))), "slots")
    counted = turns.groupBy("source_no").agg(F.count("*").alias("blocks"))
    plan = plan.join(counted, "source_no", "left").withColumn("block", F.ceil(F.col("target_words") / F.col("blocks")).cast("long"))
    plan = materialise(plan, "blocks")

    # documents stand in the order of their hash as an unsigned number; a bucket is a prefix of it, so their number changes nothing
    bits = min(62, max(8, (int(rows) // GROUP_ROWS).bit_length()))
    sized = sized.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    sums = sums.withColumn("base", F.coalesce(F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(*_BEFORE)), F.lit(0)))
    sums = sums.join(plan, sums["source"].eqNullSafe(plan["source"])).select("source_no", "source_size", "target", "target_words", "block", "bucket", "base", plan["source"])
    own = sized.withColumn("inner", F.coalesce(F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(*_BEFORE)), F.lit(0)))
    placed = own.join(sums, own["source"].eqNullSafe(sums["source"]) & (own["bucket"] == sums["bucket"]))
    placed = materialise(placed.select("doc_id", sums["source"], "size", "source_size", "target", "target_words", "block", "source_no", (F.col("base") + F.col("inner")).alias("start"), *keep), "placed")

    passes = F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda e: F.col("start") + e * F.col("source_size"))
    unrolled = placed.where("size > 0").select("*", F.explode(passes).alias("at")).where("at < target_words")
    unrolled = unrolled.withColumn("stop", F.least(F.col("at") + F.col("size"), "target_words"))
    blocks = F.expr("sequence(at div block, (stop - 1) div block)")
    pieces = unrolled.select("doc_id", "source_no", "start", "at", "stop", "block", F.explode(blocks).alias("rank"))
    taken = pieces.join(turns, ["source_no", "rank"]).select(
        "slot", "doc_id", "source_no", "start",
        (F.greatest("at", F.col("rank") * F.col("block")) - F.col("at")).alias("from_word"), (F.least("stop", (F.col("rank") + 1) * F.col("block")) - F.col("at")).alias("to_word"),
    )
    return taken, placed


def mix(docs: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and the columns `keep`: one row for each row of docs."""
    taken, placed = schedule(docs, keep=keep, **options)
    words = taken.groupBy("source_no", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    # only documents with words have a place of their own in the stream
    key = F.when(F.col("size") > 0, F.col("start"))
    met = placed.withColumn("place", key).join(words.withColumnRenamed("start", "place"), ["source_no", "place"], "left")
    return met.select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), *keep)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target and taken added: the corpus that the mix takes, texts and all."""
    numbered = materialise(docs.drop("size", "source_size", "target", "taken").withColumn("__mix_row", F.monotonically_increasing_id()), "numbered")
    found = mix(numbered, keep=("__mix_row",), **options).select("__mix_row", "size", "source_size", "target", "taken")
    return numbered.join(found, "__mix_row").drop("__mix_row")
