"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is as toxic as its worst window of 24 words: each window's pieces (see subword.py) are averaged and read by
the softmax, and the highest logit counts, so a few words in a long text are seen and unseen spellings of them
share n-gram vectors. Labels mark texts, not windows: after a first fit on all windows, a second takes a toxic
text's windows that look toxic, at least its best one.

Edge cases: null and blank texts score as the median text of label 0; without labels of both classes every text scores the
same, near 0 unless all labels are 1. Ties and repeated rows score alike. Empty tables give empty results.
Labels are read from rows whose crc32(doc_id) mod 3 is not 1 alone; lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from discloom.llm import subword
from discloom.llm.classify import THRESHOLD, labelled_sample, remainder, scored_rows, scores

HELD_OUT = (3, 1)


def fit(docs: DataFrame, labels: DataFrame) -> subword.Model:
    n, held = HELD_OUT
    rows = labelled_sample(docs, labels, "toxic", 1, remainder(F.col("doc_id"), n) != held)
    texts, known = [t for t, _ in rows], [y for _, y in rows]
    return subword.train(texts, known, fold=True, pooling="max", epochs=6)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    n, held = HELD_OUT
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", (remainder(F.col("doc_id"), n) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under the threshold, with their own columns."""
    found = scored_rows(docs, fit(docs, labels), "__toxicity")
    return found.where(F.col("__toxicity") < THRESHOLD).drop("__toxicity")
