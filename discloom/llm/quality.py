"""Quality classifier: supervised subword embeddings, hashed word, word-pair and character n-gram vectors averaged per
document, with a softmax output trained by numpy stochastic gradient descent.

Case is kept. A whole text's pieces are averaged (see subword.py).

Edge cases: null and blank texts score as the median text of label 0; without labels of both classes every text scores the
same. Ties and repeated rows score alike. Empty tables give empty results. Labels are read from rows whose
crc32(doc_id) mod 4 is not 2 alone; lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from discloom.llm import subword
from discloom.llm.classify import THRESHOLD, labelled_sample, remainder, scores

HELD_OUT = (4, 2)


def fit(docs: DataFrame, labels: DataFrame) -> subword.Model:
    n, held = HELD_OUT
    rows = labelled_sample(docs, labels, "quality", 0, remainder(F.col("doc_id"), n) != held)
    return subword.train([t for t, _ in rows], [y for _, y in rows], fold=False, pooling="mean", epochs=5)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    n, held = HELD_OUT
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", (remainder(F.col("doc_id"), n) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
