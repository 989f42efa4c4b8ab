"""What the corpus operators share: shared-folder tables, batch bounds and byte views of text columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from discloom import session

#: Rows and bytes of an Arrow batch given to Python: a batch ends at the first bound that it reaches (a longer row stands alone).
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20
#: Rows of a file of a table of a few numbers.
FILE_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one in local mode only."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="discloom-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/discloom/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made inside are deleted at the end: what they were made for must be written by then, to a path from outside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            drop_path(spark, path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and the planner knows its size.

    Spark's commit protocol makes the table whole or absent, so it outlives lost executors.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, known to have at most `rows` narrow rows, in no more partitions than FILE_ROWS asks for: small tables make few files."""
    return df.coalesce(max(1, -(-rows // FILE_ROWS)))


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> None:
    """Lowers an Arrow batch to at most `rows` rows and about `most_bytes` bytes, on both sides of the pipe to a Python worker."""
    session.bounded_batches(spark, rows, most_bytes)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column one after another, and the row offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes sum to at most `most`; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def windows(text: Column, doc_id: Column, chars: int, n: int, whole_words: bool = False) -> Column:
    """A text of up to `chars` characters whole; of a longer one a window from each of n equal parts, at a place chosen by a hash."""
    part, size = F.floor(F.length(text) / n), chars // n
    cut = [F.substr(text, (part * k + F.pmod(F.xxhash64(doc_id, F.lit(k)), part - size + 1) + 1).cast("int"), F.lit(size)) for k in range(n)]
    if whole_words:
        cut = [F.regexp_replace(x, r"^\S*\s|\s\S*$", "") for x in cut]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *cut))
