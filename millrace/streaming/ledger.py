"""Event ledgers as streams: late and repeated deliveries change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OVERLAP = "2 hours"


def once_per_key(events: DataFrame, key: str = "event_key", at: str = "ts", overlap: str = OVERLAP) -> DataFrame:
    """Drops deliveries of a key that came within the overlap; state is kept for so long only."""
    return events.withWatermark(at, overlap).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, group: str, size: str = "1 hour", slide: str | None = None, overlap: str = OVERLAP) -> DataFrame:
    """Counts by event-time window; windows close when the watermark passes them."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, overlap).groupBy(w, group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), group, "n")


def append_new(folder: str, key: str, at: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends only rows whose key the table lacks, so that a replayed batch adds nothing.

    at: the events' time, which deliveries of a key share. The table is then kept by day, and keys are looked up in the
    days of the batch alone.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        days = []
        if at is not None:
            fresh = fresh.withColumn("day", F.date_format(at, "yyyy-MM-dd"))
            days = [r.day for r in fresh.select("day").distinct().collect()]
        try:
            held = spark.read.parquet(folder)
        except Exception as e:  # the table's first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            some = held if at is None else held.where(F.col("day").cast("string").isin(days))
            fresh = fresh.join(some.select(key), key, "left_anti")
        out = fresh.write.mode("append")
        (out if at is None else out.partitionBy("day")).parquet(folder)

    return write


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Works off what there is, in micro-batches, and stops; progress is kept in the checkpoint only after a batch succeeded."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def folder_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
