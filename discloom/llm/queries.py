"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from discloom.llm import avi, chat, decontaminate, line_dedup, minhash, warc
from discloom.llm.decontaminate import find_contamination
from discloom.llm.lang_id import identify_languages
from discloom.llm.minhash import near_duplicates
from discloom.llm.mixing import mix
from discloom.llm.quality import score_quality
from discloom.llm.toxicity import score_toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.dedup_lines(docs, counts=True)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(_read(spark, sf_dir, "pages"))
    return warc.complete(warc.read_warc(manifest, payloads=False), manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(chat.PROBE, "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_chats(chat.as_events(log.unionAll(probe)), seq="seq", message="message", op="op"))


def op6_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.media_features(avi.encode_media(_read(spark, sf_dir, "documents"))).drop("clips")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_avi_media": op6_avi_media,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op4_warc": warc.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op7_minhash_near_dedup": minhash.ORACLE,
    "op10_benchmark_decontamination": decontaminate.ORACLE,
}
