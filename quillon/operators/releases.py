"""Release histories: gaps, dormancy, cadence, version order, maintainers."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.core import half_up, in_order, micros

DAY = 86_400_000_000
#: Days of dormancy and its confidences, multiple of the median gap, releases needed, and days a maintainer counts as new.
DORMANT, LONG_DORMANT = (180, 0.6), (540, 0.8)
MULTIPLE, RELEASES, NEW_DAYS, NEW_ACCOUNT_DAYS, FEW_PACKAGES = 8, 5, 30, 90, 3


def gaps(releases: DataFrame) -> DataFrame:
    """Each release with the days since the one before it (null for the first), to the microsecond."""
    order = Window.partitionBy("package_id").orderBy("published_at", "release_id")
    before = F.lag("published_at").over(order)
    rows = releases.withColumn("_before", before)
    return rows.withColumn("gap_days", (micros("published_at") - micros("_before")) / DAY).drop("_before")


def dormancy(releases: DataFrame) -> DataFrame:
    """Releases after a long silence, with the confidence of that."""
    gap = F.col("gap_days")
    confidence = F.when(gap >= LONG_DORMANT[0], LONG_DORMANT[1]).when(gap >= DORMANT[0], DORMANT[1])
    return gaps(releases).select("package_id", "release_id", half_up(gap, 3).alias("gap_days"), confidence.alias("confidence")).where("confidence is not null")


class Median:
    """The median of what was put in so far: the lower half in a heap with its largest on top, the upper half in one with its smallest."""

    def __init__(self):
        self.low: list[float] = []
        self.high: list[float] = []

    def put(self, value: float) -> None:
        heappush(self.high, -heappushpop(self.low, -value))
        if len(self.high) > len(self.low):
            heappush(self.low, -heappop(self.high))

    def value(self) -> float | None:
        """The middle, or the mean of the two middle ones; None when empty."""
        if not self.low:
            return None
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2


def unusual(package, rows) -> Iterator[tuple]:
    """(package_id, release_id, gap_days, median) of the releases of one package, in order, whose gap is many times the median of those before it; rows are (package_id, release_id, microseconds)."""
    gaps_before, last, early = Median(), None, []
    for n, (_, release, at) in enumerate(rows, 1):
        if last is not None:
            gap, median = (at - last) / DAY, gaps_before.value()
            if median is not None and median > 0 and gap > MULTIPLE * median:
                early.append((package, release, gap, median))
            gaps_before.put(gap)
        last = at
        if n >= RELEASES:  # a shorter history tells nothing
            yield from early
            early = []


def cadence(releases: DataFrame) -> DataFrame:
    """Releases whose gap is many times the median of the gaps before it, in histories of some length.

    Histories are streamed in order, so a task keeps the gaps of one package, once each.
    Releases without a package or time are left out.
    """
    rows = releases.where("package_id IS NOT NULL AND published_at IS NOT NULL").select(F.col("package_id").cast("long"), F.col("release_id").cast("long"), micros("published_at").alias("at"))
    found = in_order(rows, "package_id", ["at", "release_id"], unusual, "package_id long, release_id long, gap_days double, median double")
    return found.select("package_id", "release_id", half_up(F.col("gap_days"), 3).alias("gap_days"), half_up(F.col("median"), 3).alias("median_days"), half_up(F.col("gap_days") / F.col("median"), 1).alias("multiple"))


def semver(version: Column) -> Column:
    """struct(major, minor, patch, final, prerelease); null where the text isn't a version. Structs compare in version order."""
    pattern = r"^v?(\d{1,9})\.(\d{1,9})\.(\d{1,9})(?:-([0-9A-Za-z.-]+))?(?:\+.*)?$"
    part = lambda i: F.regexp_extract(version, pattern, i)
    return F.when(
        version.rlike(pattern),
        F.struct(part(1).cast("long").alias("major"), part(2).cast("long").alias("minor"), part(3).cast("long").alias("patch"), (part(4) == "").alias("final"), part(4).alias("prerelease")),
    )


def version_jumps(releases: DataFrame) -> DataFrame:
    """Releases that skip two majors or more, or come after a higher version; ``version`` is text."""
    order = Window.partitionBy("package_id").orderBy("published_at", "release_id")
    rows = releases.withColumn("now", semver(F.col("version"))).withColumn("old", F.lag("now").over(order)).withColumn("previous", F.lag("version").over(order)).where("now is not null and old is not null")
    jump = F.col("now.major") - F.col("old.major")
    kind = F.when(jump >= 2, "jump").when(F.col("now") < F.col("old"), "out of order")
    return rows.select("package_id", "release_id", "previous", "version", kind.alias("kind")).where("kind is not null")


def new_maintainers(releases: DataFrame, events: DataFrame) -> DataFrame:
    """(package_id, release_id, actor) of maintainers added within the days before a release.

    A range join: events are filed under each of the month-long bins their range
    touches, so that it is an equi-join on package and bin.
    """
    day = lambda c: F.floor(micros(c) / DAY)
    left = releases.withColumn("bin", F.floor(day("published_at") / NEW_DAYS))
    right = events.where("type = 'ADDED'").withColumn("bin", F.explode(F.array(F.floor(day("at") / NEW_DAYS), F.floor(day("at") / NEW_DAYS) + 1)))
    near = (micros("published_at") - micros("at")).between(0, NEW_DAYS * DAY)
    return left.join(right, ["package_id", "bin"]).where(near).select("package_id", "release_id", "actor").distinct()
