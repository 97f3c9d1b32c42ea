"""Differences between what is held and what is wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def catalog_diff(held: DataFrame, wanted: DataFrame, key: str, compare: Sequence[str], active: Column, leased: Column) -> DataFrame:
    """(key, action) of every key on either side: add, reactivate, retire, conflict (would retire but is leased), update, unchanged.

    held has the compared columns and those of active and leased; wanted has the compared columns.
    """
    old = held.select(F.col(key).alias("__key"), F.lit(True).alias("__held"), active.alias("__active"), leased.alias("__leased"), *[F.col(c).alias(f"__old_{c}") for c in compare])
    new = wanted.select(key, F.lit(True).alias("__wanted"), *compare)
    both = old.join(new, F.col("__key") == F.col(key), "full_outer")
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col(f"__old_{c}").eqNullSafe(F.col(c))
    action = (
        F.when(F.col("__held").isNull(), "add")
        .when(F.col("__wanted").isNotNull() & ~F.col("__active"), "reactivate")
        .when(F.col("__wanted").isNotNull() & changed, "update")
        .when(F.col("__wanted").isNotNull(), "unchanged")
        .when(~F.col("__active"), "retired")
        .when(F.col("__leased"), "conflict")
        .otherwise("retire")
    )
    return both.select(F.coalesce(F.col(key), F.col("__key")).alias(key), action.alias("action"))


def missing_keys(expected: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(held.select(key).distinct(), key, "left_anti")


def insert_ignore(held: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """held with the new rows whose keys it lacks; of equal new keys one row is taken."""
    fresh = new.dropDuplicates(list(keys)).join(held.select(*keys), list(keys), "left_anti")
    return held.unionByName(fresh)


def upsert(held: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """held with newer rows in place of older ones of the same key, in one shuffle."""
    from millrace.operators.ranking import first_per_key

    both = held.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return first_per_key(both, keys, [F.col(version).desc_nulls_last(), F.col("__new").desc()]).drop("__new")


def compare_and_set(held: DataFrame, plan: DataFrame, key: str, expected: str, column: str, to: str) -> DataFrame:
    """Applies plan (key, expected, to) where the column still has the expected value; adds applied."""
    p = plan.select(F.col(key).alias("__key"), F.col(expected).alias("__expected"), F.col(to).alias("__to"))
    joined = held.join(p, F.col(key) == F.col("__key"), "left")
    hit = F.col("__key").isNotNull() & F.col(column).eqNullSafe(F.col("__expected"))
    return joined.select(*[F.when(hit, F.col("__to")).otherwise(F.col(column)).alias(column) if c == column else F.col(c) for c in held.columns], hit.alias("applied"))


def update_from_arrays(held: DataFrame, key: str, column: str, keys: Column, values: Column, source: DataFrame) -> DataFrame:
    """Sets a column from two parallel arrays of keys and values."""
    pairs = source.select(F.explode(F.arrays_zip(keys.alias("k"), values.alias("v"))).alias("p")).select(F.col("p.k").alias("__k"), F.col("p.v").alias("__v"))
    joined = held.join(pairs, F.col(key) == F.col("__k"), "left")
    return joined.select(*[F.coalesce(F.col("__v"), F.col(column)).alias(column) if c == column else F.col(c) for c in held.columns])


def status_changes(history: DataFrame, key: str, order: Sequence[Column], status: str) -> DataFrame:
    """Rows where the status differs from the key's row before (nulls compared as values), with the earlier status."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    held = history.withColumn("previous", F.lag(status).over(w)).withColumn("__n", F.row_number().over(w))
    return held.where((F.col("__n") == 1) | ~F.col("previous").eqNullSafe(F.col(status))).drop("__n")


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, status: str) -> DataFrame:
    """(key, old_status, new_status) of keys whose status differs between two snapshots; new keys have no old status."""
    old = before.select(F.col(key).alias("__key"), F.col(status).alias("old_status"))
    joined = after.select(key, F.col(status).alias("new_status")).join(old, F.col(key) == F.col("__key"), "left")
    return joined.where(~F.col("old_status").eqNullSafe(F.col("new_status"))).drop("__key")
