"""Index points of evidence: strategy, chunks, contextual text, stable ids, and their vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from discloom.functions.text import path_text, uuid5
from discloom.operators.profiling import embedding_strategy, pack_tables
from discloom.session import bounded_batches, scratch

#: Texts that Python holds at once: sorted by length, the longest of a task would meet in one batch.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def approximate_tokens(text: Column) -> Column:
    """A stated approximation: a token for three UTF-8 bytes. A model's own count can be passed in its place."""
    return F.ceil(F.octet_length(text) / 3).cast("long")


def _head(company: Column, report: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("company: "), company), F.concat(F.lit("report: "), report), F.concat(F.lit("section: "), path_text(F.col("heading_path"))))


def record_lines(headers: Column, records: Column) -> Column:
    """A line for each record: header paths with their values, empty values left out."""
    name = lambda i: F.coalesce(F.nullif(F.array_join(F.get(headers, i), " > "), F.lit("")), F.concat(F.lit("컬럼 "), (i + 1).cast("string")))
    cells = lambda r: F.filter(F.transform(r["values"], lambda v, i: F.when(F.trim(v) != "", F.concat(name(i), F.lit(": "), v))), lambda x: x.isNotNull())
    return F.array_join(F.transform(records, lambda r: F.array_join(cells(r), ", ")), "\n")


def field_lines(fields: Column) -> Column:
    paths = lambda f: F.transform(f["key_paths"], lambda p: F.concat(F.array_join(F.transform(p, lambda x: F.trim(x)), " > "), F.lit(": "), f["raw_value"]))
    return F.array_join(F.flatten(F.transform(fields, paths)), "\n")


def build_points(evidence: DataFrame, documents: DataFrame, row_limit: int = 1500, count: Callable[[Column], Column] = approximate_tokens) -> DataFrame:
    """Points of evidence rows joined to doc, corp_name, report_name: ids, kind, chunk and contextual_text.

    The evidence is written once and read for each kind of point: making it may be long, and Spark would do it anew for each.
    Texts and field tables are one point each. Record tables within the limit are one, others a point for each packed
    group of rows; chunk fields are set only where a table has two points or more.
    """
    met = evidence.join(documents.select("doc", "corp_name", "report_name"), "doc")
    head = _head(F.col("corp_name"), F.col("report_name"))
    key = F.concat_ws(":", F.col("doc").cast("string"), F.col("section").cast("string"), F.col("ordinal").cast("string"))
    met = met.withColumns({"evidence_id": key, "head": head, "point_kind": F.when(F.col("kind") == "TEXT", "TEXT").otherwise(F.col("table_type"))})
    body = F.when(F.col("kind") == "TEXT", F.col("text")).when(F.col("table_type") == "KV_TABLE", field_lines(F.col("fields"))).otherwise(record_lines(F.col("headers"), F.col("records")))
    met = met.withColumn("body", body).withColumn("strategy", F.when(F.col("point_kind") == "R_TABLE", embedding_strategy(count(F.col("body")), F.lit(1.0), row_limit)).otherwise("WHOLE"))
    packable = lambda x: F.when(F.col("strategy") != "WHOLE", F.col(x)).alias(x)
    path = scratch(evidence.sparkSession, "evidence")
    met.select("doc", "evidence_id", "point_kind", "head", "body", "strategy", packable("headers"), packable("records")).write.parquet(path)
    met = evidence.sparkSession.read.parquet(path)
    whole = met.where("strategy = 'WHOLE'").select("doc", "evidence_id", "point_kind", "head", "body", F.lit(None).cast("int").alias("chunk_index"), F.lit(None).cast("int").alias("chunk_count"))
    large = met.where("strategy <> 'WHOLE'").select("doc", "evidence_id", "point_kind", "head", "headers", F.explode("records").alias("r"))
    lines = large.select("doc", "evidence_id", "point_kind", "head", F.col("r.record_index").alias("pos"), record_lines(F.col("headers"), F.array("r")).alias("line"))
    packed = pack_tables(lines.withColumn("size", count(F.col("line"))), "evidence_id", "pos", "size", "greedy", row_limit)
    joined = lines.join(packed, ["evidence_id", "pos"]).groupBy("doc", "evidence_id", "point_kind", "head", "chunk_index", "chunk_count")
    chunks = joined.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"))
    several = F.col("chunk_count") > 1
    chunks = chunks.withColumns({"chunk_index": F.when(several, F.col("chunk_index")), "chunk_count": F.when(several, F.col("chunk_count"))})
    every = whole.unionByName(chunks.select(whole.columns))
    name = F.concat_ws(":", "evidence_id", F.coalesce(F.col("chunk_index").cast("string"), F.lit("whole")))
    text = F.concat_ws("\n\n", "head", F.nullif(F.col("body"), F.lit("")))
    return every.select(uuid5(NAMESPACE, name).alias("point_id"), "doc", "evidence_id", "point_kind", "chunk_index", "chunk_count", text.alias("contextual_text"), F.sha2(text, 256).alias("text_hash"))


def point_faults(evidence: DataFrame, records: DataFrame, points: DataFrame) -> DataFrame:
    """(code, id): records whose table no evidence has (orphan_record), points whose id another has too (duplicate_point_id).

    evidence and records: doc and table_id; points: point_id.
    """
    tables = evidence.where("table_id is not null").select("doc", "table_id")
    orphans = records.select("doc", "table_id").distinct().join(tables, ["doc", "table_id"], "left_anti").select(F.lit("orphan_record").alias("code"), F.col("table_id").alias("id"))
    again = points.groupBy("point_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_point_id").alias("code"), F.col("point_id").alias("id"))
    return orphans.unionAll(again)


def embed_once(points: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """points with a vector: each distinct text meets the model once, in batches of like length, and joins back by hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                yield pd.DataFrame({"text_hash": part["text_hash"], "vector": model(part["contextual_text"].tolist())})

    bounded_batches(points.sparkSession, BATCH_ROWS, BATCH_BYTES)
    distinct = points.select("text_hash", "contextual_text").dropDuplicates(["text_hash"])
    by_length = distinct.sortWithinPartitions(F.length("contextual_text"))
    return points.join(by_length.mapInPandas(run, "text_hash string, vector array<float>"), "text_hash")
