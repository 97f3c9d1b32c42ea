"""Table access. Every query reads through here, so column pruning and filters reach the Parquet scan."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HOME = str(Path(__file__).resolve().parents[1])


#: Bytes of an Arrow batch that a Python worker gets.
BATCH_BYTES = 6 << 20


def let_workers_import(spark: SparkSession) -> None:
    """Python workers that share this disk find the package; elsewhere it is sent with --py-files. Their Arrow batches hold BATCH_BYTES at most, however long the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if HOME not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), HOME]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in several parts for each core, by columns or in turn, whatever the files' sizes: small files of many rows would else be one task's work."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new folder's path where all executors see it: under spark.checkpoint.dir, or a temporary one for a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return f"{(found or tempfile.mkdtemp(prefix='millrace-')).rstrip('/')}/{what}-{uuid.uuid4().hex}"


#: Spark removes what a query shuffled when it has ended; else shuffle files stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: df as a table in the shared folder, read again. What was shuffled to make it is removed as soon as it is written."""
    conf, path = df.sparkSession.conf, shared_path(df.sparkSession, what)
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
