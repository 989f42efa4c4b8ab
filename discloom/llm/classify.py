"""Fitting a subword model on a bounded sample of labelled documents and scoring every whole text with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from discloom.llm import subword
from discloom.llm.common import bounded_batches, byte_view, windows

#: Labelled rows of either class that a model is fitted on at most, and the characters that a row gives: a longer text
#: gives WINDOWS windows from all its parts.
SAMPLE = (1200, 2000)
SAMPLE_CHARS = 6000
WINDOWS = 12
THRESHOLD = 0.7


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rare: int, allowed: Column, sample: tuple[int, int] = SAMPLE) -> list[tuple[bytes, int]]:
    """(text, label) of up to sample[0] rows of class `rare` and sample[1] of the other, chosen by a hash of doc_id.

    Rows with a null id or label, or without a document whose text has a word, are not chosen; a repeated id counts once, with
    its highest label and, of its texts, the smallest. Long texts are chosen like others and give windows of the whole text. The chosen ids are few and
    broadcast; texts of the sample alone come to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(r"\S"))
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [known.where(F.col("label") == value).orderBy(*order).limit(n) for value, n in ((rare, sample[0]), (1 - rare, sample[1]))]
    # ids come through the driver: at most sum(sample) of them
    ids = [(r.doc_id, r.label) for part in picked for r in part.collect()]
    if not ids:
        return []
    wanted = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    given = windows(F.col("text"), F.col("doc_id"), SAMPLE_CHARS, WINDOWS, whole_words=True)
    rows = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "label", given.alias("text")).groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [(r.text.encode("utf-8", "replace"), r.label) for r in rows]


def _scorer(model: subword.Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_view(batch.column(1))
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            z = subword.logits(model, texts) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(subword.sigmoid(z), 9))], ["doc_id", "score"])

    return score


def scores(docs: DataFrame, model: subword.Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row of docs."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scorer(model), "doc_id long, score double")


def scored_rows(docs: DataFrame, model: subword.Model, name: str) -> DataFrame:
    """docs with a column `name` of scores added, each row with its own: the text goes to Python, the row stays one."""
    bounded_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c != name]
    schema = docs.select(*columns).schema.add(name, "double")
    at = columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (scored,) = _scorer(model)(iter([pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["doc_id", "text"])]))
            yield pa.RecordBatch.from_arrays([*batch.columns, scored.column(1)], [*columns, name])

    return docs.select(*columns).mapInArrow(score, schema)
