"""Writers and keyed changes of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A line of JSON for each row, nulls kept; Spark's commit makes it whole or absent."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def upsert(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of base with their keys, column by column where new is not null; others are added."""
    rest = [c for c in base.columns if c not in keys]
    a, b = base.alias("a"), new.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return a.join(b, same, "full").select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in rest])


def replace_edges(edges: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All edges of new's keys give way to new's."""
    return edges.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that df has are rewritten; files of earlier runs in them go."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def answer_envelope(question_id: str, question: str, context: str, trace: str, answer: str) -> Column:
    """The five answer fields as one JSON string, nulls kept, whether the question succeeded or not."""
    names = (question_id, question, context, trace, answer)
    fields = ("question_id", "question", "retrieved_context", "think_trace", "answer")
    return F.to_json(F.struct(*[F.col(n).cast("string").alias(f) for n, f in zip(names, fields, strict=True)]), {"ignoreNullFields": "false"})


def promote(spark: SparkSession, candidate: str, golden: str, approved: bool = False) -> None:
    """Puts a candidate table in the place of the golden one, only where that is asked for in so many words."""
    if not approved:
        raise ValueError("a candidate is promoted with approved=True alone")
    spark.read.parquet(candidate).write.mode("overwrite").parquet(golden)
