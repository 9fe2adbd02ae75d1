"""Sliding windows, streaks and lockouts over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.core import micros

SECOND = 1_000_000
#: Failures before a lockout, its first and longest duration in milliseconds, and failures that disable a hook.
FAILURES, FIRST_MS, MOST_MS, DISABLED_AT = 5, 60_000, 86_400_000, 10


def sliding(events: DataFrame, keys: list[str], time: str, key: str, window_s: int, limit: int) -> DataFrame:
    """For each event the events of its bucket in the window that ends with it, what remains of the limit, and seconds until the oldest leaves."""
    at = micros(time)
    frame = Window.partitionBy(*keys).orderBy(at).rangeBetween(-window_s * SECOND + 1, 0)
    rows = events.withColumn("used", F.count("*").over(frame)).withColumn("oldest", F.min(at).over(frame))
    wait = F.when(F.col("used") >= limit, F.ceil((F.col("oldest") + window_s * SECOND - at) / SECOND)).otherwise(0)
    return rows.select(key, *keys, "used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).cast("long").alias("remaining"), wait.cast("long").alias("retry_after_s"))


def lockout_ms(failures: Column) -> Column:
    """0 for few failures, then doubling from a minute up to a day."""
    power = F.least(failures - FAILURES, F.lit(32)).cast("double")
    return F.when(failures < FAILURES, 0).otherwise(F.least(F.pow(F.lit(2.0), power) * FIRST_MS, F.lit(float(MOST_MS)))).cast("long")


def disabled(failures: Column) -> Column:
    """Whether a hook that has failed so many times in a row is switched off."""
    return failures >= DISABLED_AT


def streaks(events: DataFrame, keys: list[str], ok: Column, *order: Column) -> DataFrame:
    """Each event with the number of failures in a row that end with it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = events.withColumn("_ok", ok.cast("int")).withColumn("_island", F.sum("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("failures", F.sum(1 - F.col("_ok")).over(inside)).drop("_ok", "_island")
