"""Bounded exports: items packed into files of so many items and bytes, bound by hashes to a manifest, and the checks of files and of results that come back."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.tables import dealt, kept

#: The most items and bytes of an export.
ITEMS, BYTES = 30, 32 << 20
MANIFEST = "file string, ordinal int, key string, input_hash string, bytes long"


def offsets(rows: DataFrame, order: str, size: str) -> DataFrame:
    """Adds at, which rises with the order, start, the sizes of all rows before, and before, the marked rows among them. rows: order is unique; marked boolean.

    Sums are taken inside sorted ranges and then over a row for each range, so that no task sees all rows.
    """
    held = kept(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("__part", F.shiftright("at", 33))
    mark = F.col("marked").cast("int")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = ahead(Window.partitionBy("__part").orderBy("at"))
    parts = held.groupBy("__part").agg(F.sum(size).alias("__s"), F.sum(mark).alias("__m"))
    over = ahead(Window.orderBy("__part"))
    parts = parts.select("__part", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}0") for c in ("__s", "__m")])
    met = held.join(F.broadcast(parts), "__part")
    sums = {"start": F.col("__s0") + F.coalesce(F.sum(size).over(inside), F.lit(0)), "before": F.col("__m0") + F.coalesce(F.sum(mark).over(inside), F.lit(0))}
    return met.withColumns(sums).drop("__part", "__s0", "__m0")


def pack(items: DataFrame, key: str, payload: str, most_items: int = ITEMS, most_bytes: int = BYTES) -> DataFrame:
    """(file, ordinal, key, payload, input_hash, bytes): items (keys are unique) in files of at most most_items items and most_bytes bytes, line ends counted, in order of key.

    An item goes to the file of the half limit in which its first byte falls, so that what begins in one half ends within the next; items of more than half the
    limit have a file each. Items beyond the limit, and null payloads, are in no file; see too_large().
    """
    half = most_bytes // 2
    rows = items.select(F.col(key).alias("__key"), F.col(payload).alias("payload")).withColumn("bytes", (F.octet_length("payload") + 1).cast("long"))
    rows = rows.where(F.col("bytes") <= most_bytes).withColumn("marked", F.col("bytes") > half)
    placed = offsets(rows, "__key", "bytes").withColumn("bucket", F.floor(F.col("start") / half))
    group = ["before", "marked", "bucket"]
    n = F.row_number().over(Window.partitionBy(*group).orderBy("at")) - 1
    file = F.format_string("%08d-%d-%08d-%05d", F.col("before"), F.col("marked").cast("int"), F.col("bucket"), F.floor(n / most_items).cast("int"))
    return placed.select(file.alias("file"), (n % most_items).cast("int").alias("ordinal"), F.col("__key").cast("string").alias("key"), "payload", F.sha2("payload", 256).alias("input_hash"), "bytes")


def too_large(items: DataFrame, key: str, payload: str, most_bytes: int = BYTES) -> DataFrame:
    return items.where(F.col(payload).isNull() | (F.octet_length(payload) + 1 > most_bytes)).select(key)


def manifests(packed: DataFrame) -> DataFrame:
    """(file, n_items, bytes, manifest_hash) of the files; the hash is over ordinals, keys and input hashes in order."""
    line = F.concat_ws(":", "ordinal", "key", "input_hash")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"])
    return packed.groupBy("file").agg(F.count("*").alias("n_items"), F.sum("bytes").alias("bytes"), F.sha2(F.array_join(lines, "\n"), 256).alias("manifest_hash"))


def write_export(packed: DataFrame, folder: str, apart: bool = False) -> None:
    """A folder of JSON Lines, and beside it the manifest of all items.

    Each line names its file of the export, whose lines stand together and in order in one written file; so there are no more written files than tasks,
    however many files the export has. With `apart` each file of the export has a folder of its own: storage then makes, lists and opens as many.
    """
    packed = kept(packed, "packed")
    lines = dealt(packed.select("file", "ordinal", "key", "payload"), "file").sortWithinPartitions("file", "ordinal")
    (lines.write.partitionBy("file") if apart else lines.write).json(f"{folder}/items")
    packed.select("file", "ordinal", "key", "input_hash", "bytes").write.parquet(f"{folder}/manifest")


def read_export(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(items with their hashes as they are in the files, the manifest) of an export, in either form of write_export()."""
    found = spark.read.schema("ordinal int, key string, payload string, file string").json(f"{folder}/items")
    return found.withColumn("input_hash", F.sha2("payload", 256)), spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def faults(found: DataFrame, manifest: DataFrame, bound: Mapping[str, str] | None = None) -> DataFrame:
    """(file, key, fault): how items or results (file, ordinal, key, input_hash) differ from the manifest.

    `missing` and `extra` of a file's members, `repeated` members, `order` where a member's ordinal is another, `hash` where its input is another; with `bound`
    (column: value) also `version` where a result's column differs. Both sides are met by one full join on file and key.
    """
    once = found.groupBy("file", "key").agg(F.count("*").alias("n"), F.min("ordinal").alias("ordinal"), F.max("ordinal").alias("last"), F.min("input_hash").alias("input_hash"), *[F.bool_and(F.col(c).eqNullSafe(v)).alias(f"__{c}") for c, v in (bound or {}).items()])
    m = manifest.select("file", "key", F.col("ordinal").alias("due"), F.col("input_hash").alias("bound_hash"))
    met = once.join(m, ["file", "key"], "full_outer")
    there, known = F.col("n").isNotNull(), F.col("due").isNotNull()
    checks = {"missing": ~there, "extra": ~known, "repeated": there & (F.col("n") > 1), "order": there & known & ((F.col("ordinal") != F.col("due")) | (F.col("last") != F.col("due"))), "hash": there & known & ~F.col("input_hash").eqNullSafe(F.col("bound_hash"))}
    if bound:
        checks["version"] = there & ~reduce(Column.__and__, [F.col(f"__{c}") for c in bound])
    named = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()]))
    return met.select("file", "key", F.explode(named).alias("fault"))
