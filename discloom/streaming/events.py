"""Streams of the events table: micro-batches with bounded input, deduplicated state and late corrections.

The windowed counts are an addition; the rest restates incremental loading as streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from discloom.operators.relational import correction_chain


#: Buckets of keys that keep_latest() rewrites apart.
BUCKETS = 64


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of parquet files; what a batch takes is bounded by files."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_events(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def windowed_counts(events: DataFrame, width: str = "1 day", lateness: str | None = "1 day") -> DataFrame:
    """Counts and totals by window and type; lateness None where events have a watermark already."""
    marked = events.withWatermark("ts", lateness) if lateness else events
    counted = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def keep_latest(events: DataFrame, target: str, checkpoint: str, key: str = "user_id", position: str = "event_id", available_now: bool = True) -> StreamingQuery:
    """Upserts the last row of each key into buckets of keys under target; batch n rewrites only the buckets that it touches.

    Bucket b of batch n is the folder n/b; the newest folder of a bucket holds its rows, and latest() reads those. A batch that
    runs again overwrites its own folders alone. Folders that two later batches have replaced are removed.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark, store = batch.sparkSession, _Store(batch.sparkSession, target)
        own = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()
        touched = sorted(r[0] for r in own.select("_bucket").distinct().collect())  # BUCKETS numbers at most
        newest = store.newest(before=number)
        old = [f"{target}/{newest[b]}/_bucket={b}" for b in touched if b in newest]
        every = own
        if old:
            kept = spark.read.schema(batch.schema).parquet(*old)
            every = own.unionByName(kept.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")))
        rest = [c for c in batch.columns if c != key]
        last = every.groupBy("_bucket", key).agg(F.max_by(F.struct(*rest), position).alias("r")).select("_bucket", key, "r.*")
        last.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{target}/{number}")
        own.unpersist()
        store.drop_replaced(number)

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class _Store:
    """The folders that keep_latest() writes: batch/_bucket=b."""

    def __init__(self, spark: SparkSession, target: str):
        self.root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folders(self) -> dict[int, list[int]]:
        """Buckets of each batch that is whole."""
        child = lambda parent: [s.getPath() for s in self.fs.listStatus(parent) if s.isDirectory()] if self.fs.exists(parent) else []
        found = {}
        for batch in child(self.root):
            own = [p.getName() for p in child(batch)]
            if batch.getName().isdigit() and any(s.getPath().getName() == "_SUCCESS" for s in self.fs.listStatus(batch)):
                found[int(batch.getName())] = [int(n.removeprefix("_bucket=")) for n in own if n.startswith("_bucket=")]
        return found

    def newest(self, before: int | None = None) -> dict[int, int]:
        return {b: n for n, own in sorted(self.folders().items()) if before is None or n < before for b in own}

    def drop_replaced(self, number: int) -> None:
        """Folders that a batch before the last has replaced: a batch that runs again still finds what it read."""
        kept = self.newest(before=number)
        for n, own in self.folders().items():
            for b in own:
                if n < kept.get(b, n):
                    self.fs.delete(self.root.suffix(f"/{n}/_bucket={b}"), True)


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The rows that keep_latest() has kept so far."""
    paths = [f"{target}/{n}/_bucket={b}" for b, n in _Store(spark, target).newest().items()]
    if not paths:
        raise ValueError(f"nothing is kept under {target}")
    return spark.read.parquet(*paths)


def apply_corrections(chain: DataFrame, late: DataFrame, root: str, receipt: str) -> DataFrame:
    """The chains of the roots that late corrections touch, told anew; other rows stay as they are."""
    touched = late.select(root).distinct()
    base = chain.select(root, receipt)
    again = correction_chain(base.join(touched, root, "left_semi").unionByName(late.select(root, receipt)).distinct(), root, receipt)
    return chain.join(touched, root, "left_anti").unionByName(again.select(chain.columns))
