"""Constraints as queries that return what violates them, and snapshots of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Hex digits of a snapshot's bucket: 65,536 buckets of a group.
BUCKET_DIGITS = 4


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, code) of each rule that a row breaks: one scan for all row rules."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(code)) for code, rule in rules.items()]))
    return df.select(*key, F.explode(codes).alias("code"))


def dense_order(df: DataFrame, group: str, order: str, first: int, code: str) -> DataFrame:
    """Groups whose order values are not first, first + 1, ... without gaps or repeats."""
    out = df.groupBy(group).agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.countDistinct(order).alias("d"), F.count("*").alias("n"))
    return out.where((F.col("lo") != first) | (F.col("hi") - F.col("lo") + 1 != F.col("n")) | (F.col("d") != F.col("n"))).select(group, F.lit(code).alias("code"))


def unique_key(df: DataFrame, key: list[str], code: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit(code).alias("code"))


def all_violations(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def snapshot(df: DataFrame, group: str, key: str, value: Column) -> DataFrame:
    """Rows and an order-free SHA-256 of each group: rows' own digests, sorted, joined and hashed again bucket by bucket, then the buckets'.

    A bucket is a prefix of BUCKET_DIGITS hex digits of the digests, so no task gathers a whole group.
    """
    own = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.coalesce(value.cast("string"), F.lit("\x00"))), 256)
    return _bucketed(df.select(group, own.alias("h"), F.lit("").alias("o")), group, F.left("h", F.lit(BUCKET_DIGITS)))


def combined_hash(files: DataFrame, group: str, path: Column, content: Column) -> DataFrame:
    """SHA-256 over a source's files in order of path: path, NUL, SHA-256 of the content and a line break of each.

    A source is a disclosure with a handful of files: what a group gathers is a line for each.
    """
    line = F.struct(path.alias("o"), F.concat(path, F.lit("\x00"), F.sha2(content, 256), F.lit("\n")).alias("h"))
    told = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["h"]), "")
    return files.groupBy(group).agg(F.sha2(told, 256).alias("combined"))


def _bucketed(rows: DataFrame, group: str, bucket: Column) -> DataFrame:
    joined = lambda x: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["h"]), ""), 256)
    parts = rows.withColumn("_bucket", bucket).groupBy(group, "_bucket").agg(F.count("*").alias("n"), joined(F.struct("o", "h")).alias("h"))
    return parts.groupBy(group).agg(F.sum("n").alias("rows"), joined(F.struct("_bucket", "h")).alias("sha256"))


def probes(df: DataFrame, group: str, position: str) -> DataFrame:
    """First, middle and last row of each group."""
    order = Window.partitionBy(group).orderBy(position)
    n = F.count("*").over(Window.partitionBy(group))
    at = F.row_number().over(order) - 1
    ranked = df.withColumns({"_at": at, "_n": n})
    return ranked.where((F.col("_at") == 0) | (F.col("_at") == F.floor(F.col("_n") / 2)) | (F.col("_at") == F.col("_n") - 1)).drop("_at", "_n")
