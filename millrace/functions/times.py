"""Dates and windows. The clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/Chicago"


def local_day(ts: Column, zone: str = ZONE) -> Column:
    """Calendar day in a zone of a UTC time stored without a zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def day_spine(spark: SparkSession, last: Column, days: int, name: str = "day") -> DataFrame:
    """The `days` calendar days that end with `last`, a row each."""
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias(name))


def within(ts: Column, now: Column, interval: str) -> Column:
    """Whether a time lies in the trailing interval before now, its start included."""
    return ts >= now - F.expr(f"INTERVAL {interval}")


def next_utc_day(now: Column) -> Column:
    return F.date_trunc("day", now) + F.expr("INTERVAL 1 DAY")


def next_utc_month(now: Column) -> Column:
    return F.date_trunc("month", now) + F.expr("INTERVAL 1 MONTH")


def age_hours(ts: Column, now: Column) -> Column:
    """Hours since a time, one decimal."""
    return F.round((F.unix_millis(now.cast("timestamp")) - F.unix_millis(ts.cast("timestamp"))) / 3.6e6, 1)


def epoch_instant(number: Column) -> Column:
    """A time from a number of seconds, or of milliseconds if it is 1e11 or more."""
    return F.timestamp_millis(F.when(F.abs(number) < F.lit(100_000_000_000), number * 1000).otherwise(number).cast("long"))


def catch_up_window(watermark: Column, now: Column, lookback: str = "24 HOURS", longest: str = "7 DAYS", overlap: str = "2 HOURS") -> Column:
    """struct<window_start, is_catch_up>: from the watermark less an overlap (or the look-back where there is none), but at most `longest` ago and never after now."""
    earliest, usual = now - F.expr(f"INTERVAL {longest}"), now - F.expr(f"INTERVAL {lookback}")
    wanted = F.coalesce(watermark - F.expr(f"INTERVAL {overlap}"), usual)
    start = F.least(F.greatest(wanted, earliest), now)
    return F.struct(start.alias("window_start"), F.coalesce(watermark < usual, F.lit(False)).alias("is_catch_up"))


def rotation_window(now: Column, size: int, total: int, hours: int = 1) -> Column:
    """First of `size` items to take this hour, so that all of `total` come round in turn."""
    return F.pmod(F.floor(F.unix_millis(now.cast("timestamp")) / (3_600_000 * hours)) * size, F.lit(total))
