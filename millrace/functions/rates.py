"""Guarded percentages and counter equations: unknown is null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(x + 0.5)


def safe_rate(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; null where the whole is 0 or less."""
    return F.when(whole > 0, half_up(part * 1000.0 / whole) / 10)


def precise_rate(part: Column, whole: Column) -> Column:
    """As safe_rate, but three decimals where a positive share would show as 0."""
    share = part * 100.0 / whole
    return F.when(whole <= 0, None).when(part == 0, F.lit(0.0)).when(share < 0.05, half_up(share * 1000) / 1000).otherwise(half_up(share * 10) / 10)


def stage_metric(lifetime: Column, value: Column) -> Column:
    """struct<value, reason>: a stage that never counted anything is not instrumented rather than 0."""
    return F.when(F.coalesce(lifetime, F.lit(0)) == 0, F.struct(F.lit(None).cast("long").alias("value"), F.lit("not_instrumented").alias("reason"))).otherwise(F.struct(value.cast("long").alias("value"), F.lit(None).cast("string").alias("reason")))


def reconciles(seen: Column, inserted: Column, duplicates: Column, filtered: Column, processing_errors: Column) -> Column:
    """Every record seen has exactly one outcome; provider errors are no records."""
    return seen == inserted + duplicates + filtered + processing_errors


def decimal_average(x: Column) -> Column:
    """Average rounded to one decimal through decimals, as a double."""
    return F.round(F.avg(x.cast("decimal(38,10)")), 1).cast("double")


def coverage(day: Column, since: Column) -> Column:
    """untracked before tracking began (or if it never did), partial on its first day, tracked after."""
    return F.when(since.isNull() | (day < since), "untracked").when(day == since, "partial").otherwise("tracked")


def throughput(seen: Column, millis: Column) -> Column:
    """Records an hour with two decimals; null without time."""
    return F.when(millis > 0, F.round((seen.cast("decimal(30,0)") * 3_600_000) / millis, 2).cast("double"))
