"""Session construction and table access shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "discloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC as its zone; `conf` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); in local mode without one, in a temporary folder."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="discloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        where = f"file://{where}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/discloom/{label}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, rows: int, most_bytes: int) -> None:
    """Lowers an Arrow batch to at most `rows` rows and about `most_bytes` bytes, on both sides of the pipe to a Python worker."""
    for key, default, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864", most_bytes)):
        if not 0 < int(spark.conf.get(key, default)) <= most:
            spark.conf.set(key, str(most))
