"""Points in ranges, as an equi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inside(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with each range of the same key that it lies in, both ends included.

    Ranges are filed under all bins of ``width`` that they touch and points under
    theirs, so that a key's points and ranges meet bin by bin: pairs that share no
    bin are never made, and a key with many of them is dealt out by its bins. The
    other columns of both sides are kept; null positions, and ranges that end before
    they start, match nothing.
    """
    bin_of = lambda c: F.floor(F.col(c) / width)
    left = points.withColumn("_bin", bin_of(at))
    right = ranges.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    return left.join(right, [*keys, "_bin"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_bin")
