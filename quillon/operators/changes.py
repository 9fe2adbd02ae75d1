"""Changes of tables that are never changed in place: new state from old state and delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is free are added; of several with one key, one."""
    return old.unionByName(new.join(old, keys, "left_anti").dropDuplicates(keys))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those with their key; its keys are unique."""
    return old.join(new.select(keys), keys, "left_anti").unionByName(new)


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """All children of the parents in ``new`` are replaced by the rows of ``new``."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def update_where(df: DataFrame, test: Column, **values) -> DataFrame:
    """Columns change where the test holds; where it is null they don't."""
    return df.withColumns({c: F.when(test, F.lit(v) if not isinstance(v, Column) else v).otherwise(F.col(c)) for c, v in values.items()})


def update_join(df: DataFrame, keys_of: DataFrame, keys: list[str], **values) -> DataFrame:
    """Columns change on rows whose key is listed."""
    marked = df.join(keys_of.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return update_where(marked, F.col("_hit"), **values).drop("_hit").select(df.columns)


def delete_where(df: DataFrame, test: Column) -> DataFrame:
    """Rows go where the test holds; where it is null they stay."""
    return df.where(~F.coalesce(test, F.lit(False)))


def increment(counters: DataFrame, deltas: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Counters plus the sums of their deltas; a delta whose ``reset`` is true sets its counter to 0 instead."""
    sums = deltas.groupBy(*keys).agg(F.sum("delta").alias("_delta"), F.bool_or("reset").alias("_reset"))
    value = F.when(F.coalesce("_reset", F.lit(False)), 0).otherwise(F.col(column) + F.coalesce("_delta", F.lit(0)))
    return counters.join(sums, keys, "left").withColumn(column, value).select(counters.columns)


def enqueue(queue: DataFrame, wanted: DataFrame, keys: list[str], running: list[str]) -> DataFrame:
    """Wanted keys that nothing in the queue works on yet, once each; asking again changes nothing."""
    busy = queue.where(F.col("status").isin(running)).select(keys)
    return wanted.select(keys).distinct().join(busy, keys, "left_anti")


#: States from which an analysis may run again.
RERUNNABLE = ["QUEUED", "FAILED", "PARTIAL"]


def rerunnable(queue: DataFrame) -> DataFrame:
    return queue.where(F.col("status").isin(RERUNNABLE))


def append(df: DataFrame, path: str) -> None:
    """Rows are added to a table that is only ever added to, such as the audit log or evaluation runs."""
    df.write.mode("append").parquet(path)


def claim(queue: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n queued rows, to be marked as running by ``update_join``."""
    return queue.where("status = 'QUEUED'").orderBy(*order).limit(n)
