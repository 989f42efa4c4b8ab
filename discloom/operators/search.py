"""Dense, sparse and hybrid top-k search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rank fusion's constant (Cormack et al., 2009); the lists fused are OVERFETCH times as long as the result.
RRF_C, OVERFETCH = 60, 5
#: Facts are tested in blocks of FACT_BLOCK; blocks of up to FACT_BYTES of fact text in all are broadcast, beyond it they are dealt in a Cartesian product.
FACT_BLOCK, FACT_BYTES = 500, 4 << 20


#: Fixed patterns: tokens of a fact, case kept, and what ends a sentence.
FACT_TOKEN, SENTENCE_END = "[0-9A-Za-z가-힣]+", r"[.!?\n]+"


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def dense_topk(points: DataFrame, query: list[float], k: int, id_col: str, vector: str, where: Column | None = None) -> DataFrame:
    """The k nearest points by cosine, filtered before they are ranked; ties go to the smaller id."""
    rows = points if where is None else points.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select(id_col, F.round(dot(F.col(vector), q) / (norm(F.col(vector)) * norm(q)), 9).alias("score"))
    top = scored.orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))  # k rows


#: Scores of a block of points that are held at once, and pairs whose scores are summed at once.
BLOCK_SCORES, EXACT_PAIRS = 1 << 22, 50_000


def _padded(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision, filled with zeros to the longest, and their lengths; -1 for one that is null or holds a null)."""
    rows = [None if v is None or None in v else v for v in vectors.to_pylist()] if vectors.null_count or vectors.flatten().null_count else None
    lengths = np.array([-1 if v is None else len(v) for v in rows]) if rows is not None else pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), max(0, lengths.max(initial=0))))
    if rows is not None:
        for k, v in enumerate(rows):
            out[k, : len(v or ())] = v or ()
    elif len(vectors):
        out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out, lengths


def _leading(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the pairs that may be among a query's k best once scores are rounded: k of each score by id, as far as the k-th score goes."""
    nan = np.isnan(score)
    key = np.where(nan, np.inf, score)
    order = np.lexsort((ids, ~nan, -key, q))
    q, key, nan = q[order], key[order], nan[order]
    at = np.arange(len(q))

    def turn(new: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at

    other = np.r_[True, q[1:] != q[:-1]][: len(q)]
    first = turn(other)
    alike = at - turn(other | np.r_[True, (key[1:] != key[:-1]) | (nan[1:] != nan[:-1])][: len(q)])
    last = np.append(first[1:][other[1:]] - 1, len(q) - 1)[np.cumsum(other) - 1] if len(q) else at
    return order[(alike < k) & (key >= key[np.minimum(first + k - 1, last)] - 2e-9)]


def dense_topk_many(points: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, query_id: str, query_vector: str, most: int = 10_000) -> DataFrame:
    """top k of every query of a stated, bounded query set against all points; the queries go to every task once counted.

    Blocks of points meet all queries in one matrix product, which only tells what may be among a query's best of its task; these
    pairs are summed again in the order of dot(). So scores, ties and ranks are those of all pairs, and no row is made of a pair.
    """
    if (n := queries.count()) > most:
        raise ValueError(f"{n} queries; at most {most} at once")
    asked = queries.where(F.col(query_id).isNotNull()).select(query_id, query_vector).toArrow()
    names, (q_vectors, q_lengths) = asked.column(0).to_numpy(), _padded(asked.column(1).combine_chunks())
    kept = points.where(F.col(id_col).isNotNull()).select(id_col, vector)
    schema = StructType([StructField(query_id, queries.schema[query_id].dataType), StructField(id_col, points.schema[id_col].dataType), StructField("score", DoubleType())])
    fields = to_arrow_schema(schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = -np.inf
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, names.dtype))
        least = np.full(len(names), none)
        norm = np.abs(q_vectors).sum(1).max(initial=0)
        step = max(1, BLOCK_SCORES // max(1, len(names)))
        for batch in batches if len(names) else ():
            ids, (own, lengths) = batch.column(0).to_numpy(zero_copy_only=False), _padded(batch.column(1))
            width = max(own.shape[1], q_vectors.shape[1])
            own, wanted = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (own, q_vectors))
            for start in range(0, len(ids), step):
                part, size, name = own[start : start + step], lengths[start : start + step], ids[start : start + step]
                scores = part @ wanted.T
                uneven = (size[:, None] != q_lengths) | (q_lengths < 0) if (size != q_lengths[0]).any() or (q_lengths != q_lengths[0]).any() or q_lengths[0] < 0 else None
                if uneven is not None:
                    scores[uneven] = none
                near = ~(scores < least - 2e-9 - 1e-12 * norm * np.abs(part).max(initial=0))
                row, q = np.nonzero(near)
                differ = name[row] != names[q]
                row, q = row[differ], q[differ]
                for at in range(0, len(q), EXACT_PAIRS):
                    r, c = row[at : at + EXACT_PAIRS], q[at : at + EXACT_PAIRS]
                    exact = np.cumsum(part[r] * wanted[c], axis=1)[:, -1] + 0.0 if width else np.zeros(len(r))
                    if uneven is not None:
                        exact[uneven[r, c]] = none
                    best = tuple(np.concatenate(x) for x in zip(best, (c, exact, name[r]), strict=True))
                    lead = _leading(*best, k)
                    best = tuple(x[lead] for x in best)
                # the k-th of a query that has as many
                order = np.lexsort((-np.where(np.isnan(best[1]), np.inf, best[1]), best[0]))
                q, s = best[0][order], best[1][order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                least[q[place == k - 1]] = np.where(np.isnan(s), np.inf, s)[place == k - 1]
        if len(best[0]):
            told = [pa.array(names[best[0]], fields.field(0).type), pa.array(best[2], fields.field(1).type), pa.array(best[1], pa.float64(), mask=np.isneginf(best[1]))]
            yield pa.RecordBatch.from_arrays(told, schema=fields)

    scored = kept.mapInArrow(search, schema).select(query_id, id_col, F.round("score", 9).alias("score"))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def token_weights(docs: DataFrame, id_col: str, text: str, asked: Iterable[str] | None = None) -> DataFrame:
    """(id, token, weight): how often each lower-case ASCII token of two letters or more stands in the text; asked: of these tokens alone."""
    wanted = (lambda x: F.length(x) >= 2) if asked is None else (lambda x: x.isin(*asked))
    tokens = F.filter(F.split(F.lower(text), "[^a-z]+"), wanted)
    return docs.select(id_col, F.explode(tokens).alias("token")).groupBy(id_col, "token").agg(F.count("*").alias("weight"))


def sparse_topk(weights: DataFrame, query: dict[str, int], k: int, id_col: str) -> DataFrame:
    """The k documents with the largest dot product on shared tokens; only the query's tokens are read past the scan."""
    rows = weights.where(F.col("token").isin(*query))
    q = F.coalesce(*[F.when(F.col("token") == t, F.lit(w)) for t, w in query.items()])
    scored = rows.groupBy(id_col).agg(F.sum(F.col("weight") * q).alias("score"))
    top = scored.orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))  # k rows


def fuse(lists: list[DataFrame], k: int, id_col: str, c: int = RRF_C, threshold: float | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, then top k; the threshold is on the fused score; ids seen before are left out."""
    every = lists[0].select(id_col, "rank")
    for x in lists[1:]:
        every = every.unionAll(x.select(id_col, "rank"))
    fused = every.groupBy(id_col).agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 9).alias("score"))
    if seen is not None:
        fused = fused.join(seen.select(id_col), id_col, "left_anti")
    if threshold is not None:
        fused = fused.where(F.col("score") >= threshold)
    top = fused.orderBy(F.desc("score"), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).cast("long"))  # k rows


def fact_coverage(docs: DataFrame, facts: DataFrame, doc_id: str, fact_id: str, text: str = "text") -> DataFrame:
    """(doc, fact, addressed) of every pair: does one sentence of the document hold all tokens of the fact?

    A token may stand inside a longer word. Long tokens are asked first and the whole text before its sentences, so most
    pairs end at one search; a block of facts is tested in one expression, and no row with a text is made for each pair.
    """
    tokens = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(FACT_TOKEN), 0), lambda x: F.length(x) >= 2))
    longest = F.array_sort(tokens, lambda a, b: F.length(b) - F.length(a))
    n, size = facts.agg(F.count("*"), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    block = F.pmod(F.hash(fact_id), F.lit(max(1, -(-n // FACT_BLOCK))))
    blocks = facts.select(block.alias("block"), F.struct(F.col(fact_id).alias("id"), longest.alias("tokens")).alias("f")).groupBy("block").agg(F.collect_list("f").alias("asked")).select("asked")
    rows = docs.select(doc_id, F.col(text).alias("t"), F.split(text, SENTENCE_END, -1).alias("s")).crossJoin(F.broadcast(blocks) if size <= FACT_BYTES else blocks)
    within = lambda x, f: F.forall(f["tokens"], lambda w: F.contains(x, w))
    met = lambda f: (F.size(f["tokens"]) > 0) & within(F.col("t"), f) & F.exists("s", lambda s: within(s, f))
    found = F.transform("asked", lambda f: F.struct(f["id"].alias(fact_id), met(f).alias("addressed")))
    return rows.select(doc_id, F.explode(found).alias("f")).select(doc_id, f"f.{fact_id}", "f.addressed")
