"""Newest-per-key, ordinals, interleaving, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that must be total. Ranks before any later filter: a stale first row hides fresher later ones."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def first_eligible_per_key(df: DataFrame, eligible: Column, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """Filters first and ranks what is left: an ineligible row hides nothing."""
    return first_per_key(df.where(eligible), keys, order)


def with_ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """Dense numbers from 0 within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int, largest: int = 100) -> DataFrame:
    """One page of a totally ordered result. Both numbers are clamped."""
    size = max(1, min(size, largest))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def page_totals(rows: DataFrame, number: int, size: int) -> DataFrame:
    """(total, total_pages, has_more) of a paged result."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    return rows.agg(F.count("*").alias("total")).select("total", pages.alias("total_pages"), (F.lit(number) < pages).alias("has_more"))


def in_given_order(df: DataFrame, key: str, wanted: DataFrame, position: str) -> DataFrame:
    """Rows of the wanted keys with their place in the given list."""
    return df.join(wanted, key).orderBy(position)


def last_wins(df: DataFrame, key: Column, order: Sequence[Column]) -> DataFrame:
    """One row per key, the last in order."""
    return first_per_key(df, [key], [o.desc() for o in order])


def round_robin(df: DataFrame, band: Column, group: Column, within: Sequence[Column], turn: Column) -> DataFrame:
    """Adds band, group, slot and group_turn; in their order bands run in turn and groups alternate within a band.

    turn: a number (of days, say) by which groups and members are rotated, so that no group always goes first.
    """
    held = df.withColumn("band", band).withColumn("group", group)
    inner = Window.partitionBy("band", "group")
    held = held.withColumn("__n", F.count("*").over(inner)).withColumn("__at", F.row_number().over(inner.orderBy(*within)) - 1)
    held = held.withColumn("slot", F.pmod(F.col("__at") - F.pmod(turn, F.col("__n")), F.col("__n")))
    names = held.select("band", "group").distinct()
    names = names.withColumn("__g", F.row_number().over(Window.partitionBy("band").orderBy("group")) - 1)
    counts = names.groupBy("band").agg(F.count("*").alias("__k"))
    names = names.join(counts, "band").withColumn("group_turn", F.pmod(F.col("__g") - F.pmod(turn, F.col("__k")), F.col("__k"))).drop("__g", "__k")
    return held.join(names, ["band", "group"]).drop("__n", "__at")
