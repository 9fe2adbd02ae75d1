"""Ordering, rounding and rank helpers used by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks, worst first.
VERDICTS = ["KNOWN_MALICIOUS", "LIKELY_MALICIOUS", "SUSPICIOUS", "LOW_RISK", "CLEAN"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
FAMILIES = ["INSTALL", "OBFUSCATION", "CAPABILITY", "TYPOSQUAT", "MAINTAINER", "PROVENANCE"]
#: Least score of each verdict but the last.
THRESHOLDS = [100, 55, 28, 10]
#: Rows of a part, where a task sorts or groups whole parts.
PART = 500_000


def half_up(value: Column, digits: int) -> Column:
    """Half-up on the binary value."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def rank_of(value: Column, order: list[str]) -> Column:
    """0 for the first name; null for unknown ones."""
    return reduce(lambda c, k: c.when(value == order[k], k), range(1, len(order)), F.when(value == order[0], 0))


def name_of(rank: Column, order: list[str]) -> Column:
    return F.when(rank.isNotNull(), F.element_at(F.array(*map(F.lit, order)), (rank + 1).cast("int")))


def bucket_rank(score: Column) -> Column:
    """Rank of the verdict of a score."""
    return reduce(lambda c, k: c.when(score >= THRESHOLDS[k], k), range(1, 4), F.when(score >= THRESHOLDS[0], 0)).otherwise(4)


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; ``order`` must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= n)


def page(df: DataFrame, number: int, size: int, *order: Column, most: int = 100) -> DataFrame:
    """One page of a totally ordered result; the size is clamped."""
    size = max(1, min(size, most))
    return df.orderBy(*order).offset(max(number - 1, 0) * size).limit(size)


def dense(keys: DataFrame, facts: DataFrame, on: list[str], fill: dict) -> DataFrame:
    """A row for every key of a small domain, with defaults where there is no fact."""
    return F.broadcast(keys).join(facts, on, "left").fillna(fill)


def combined(*conditions: Column | None) -> Column:
    """The conjunction of those that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def micros(time: str) -> Column:
    """Microseconds of a time column, for differences; days of other lengths come from these, not from calendar days."""
    return F.unix_micros(F.col(time).cast("timestamp"))


def parts_of(df: DataFrame, most: int = PART) -> int:
    """Into how many parts a table is dealt so that each has about ``most`` rows; the rows are counted first.

    By itself Spark goes by compressed bytes, of which a task can hold ten times
    as many in memory.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))


def record_batches(rows, schema: str, most: int = 4096):
    """Arrow batches of at most ``most`` of the rows (tuples), for tasks that must not hold all that they make."""
    from itertools import islice

    import pyarrow as pa

    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}
    rows = iter(rows)
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held), fields)], names=[n for n, _ in fields])


def in_order(df: DataFrame, key: str, order: list[str], rows_of, schema: str) -> DataFrame:
    """What ``rows_of(key, rows)`` makes of the rows of each key, one after the other in order.

    One shuffle by key and a sort that spills; rows are streamed, so a task holds
    no more than ``rows_of`` keeps. Rows are tuples of the columns of ``df``.
    """
    from itertools import groupby

    names = df.columns
    at = names.index(key)

    def run(batches):
        rows = (row for part in batches for row in zip(*(c.to_pylist() for c in part.columns)))
        return record_batches((row for own, group in groupby(rows, key=lambda row: row[at]) for row in rows_of(own, group)), schema)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
