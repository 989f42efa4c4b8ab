"""A training corpus from `documents`, in five stages of the corpus operators.

Toxic documents go; boilerplate lines go from the texts of those that stay; one document of each group of near
duplicates stays; documents that hold passages of the benchmark go; what is left is mixed to the sources' weights.
Each stage works on all that its predecessor kept, written as Parquet in the shared folder in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from discloom.llm.common import drop_path, scratch_path, scratch_scope
from discloom.llm.decontaminate import drop_contaminated
from discloom.llm.line_dedup import dedup_lines
from discloom.llm.minhash import drop_near_duplicates
from discloom.llm.mixing import mix_documents
from discloom.llm.toxicity import drop_toxic

#: SQL can express neither the trained classifier nor the seeded shuffle: tests hold near_dedup against brute force and the other
#: stages' decisions against cases planted for them.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text; no document goes."""
    cleaned = dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is left, with size, source_size, target and taken (the words that the mix takes of it)."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last is not None:
            drop_path(spark, last)  # what the stage read is written anew by now
        docs, last = spark.read.parquet(path), path
    return docs
