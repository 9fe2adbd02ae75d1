"""Latest-per-key, feeds, comparisons and dense summaries over analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.core import VERDICTS, dense, first_per, half_up, micros, name_of, rank_of

FLAGGED = ["KNOWN_MALICIOUS", "LIKELY_MALICIOUS", "SUSPICIOUS"]


def scoped(df: DataFrame, org_id: int) -> DataFrame:
    """Rows of one tenant; rows without a tenant belong to nobody."""
    return df.where(F.col("org_id") == org_id)


def newest(time: str = "completed_at", key: str = "analysis_id") -> tuple[Column, Column]:
    """Newest first with unfinished runs in front, by a unique key."""
    return F.desc_nulls_first(time), F.desc(key)


def latest(analyses: DataFrame, keys: list[str]) -> DataFrame:
    return first_per(analyses, keys, *newest())


def owned(page: DataFrame, analyses: DataFrame) -> DataFrame:
    """A page of packages with ``own_analysis_id``: the latest of the reader's own ``analyses`` that has a verdict, or null. The page is short, so it is broadcast."""
    own = analyses.where("verdict is not null").join(F.broadcast(page.select("package_id")), "package_id", "left_semi")
    order = F.struct(F.coalesce(micros("completed_at"), F.lit(-(1 << 62))), F.col("analysis_id"))
    last = own.groupBy("package_id").agg(F.max_by("analysis_id", order).alias("own_analysis_id"))
    return page.join(last, "package_id", "left")


def kpis(analyses: DataFrame) -> DataFrame:
    """All headline numbers in one pass over analyses."""
    done = F.col("completed_at").isNotNull()
    flagged = F.col("verdict").isin(FLAGGED)
    return analyses.agg(
        F.count("*").alias("analyses"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "QUEUED").alias("queued"), F.count_if(F.col("status") == "PARTIAL").alias("partial"),
        F.count_if(done & flagged).alias("flagged"), F.countDistinct("package_id").alias("packages"), F.countDistinct(F.when(flagged, F.col("package_id"))).alias("flagged_packages"),
        F.floor(F.avg(F.when(done, F.col("duration_ms"))) + 0.5).cast("long").alias("mean_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN completed_at IS NOT NULL THEN duration_ms END)").cast("long").alias("p95_ms"),
    )


def verdict_distribution(analyses: DataFrame) -> DataFrame:
    """Each verdict's number and share, with zeros for those that don't occur."""
    names = analyses.sparkSession.createDataFrame([(v, i) for i, v in enumerate(VERDICTS)], "verdict string, rank int")
    rows = dense(names, analyses.where("completed_at is not null").groupBy("verdict").agg(F.count("*").alias("n")), ["verdict"], {"n": 0})
    total, most = (f("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for f in (F.sum, F.max))  # five rows
    return rows.select("verdict", "rank", "n", half_up(100 * F.col("n") / F.greatest(total, F.lit(1)), 1).alias("share"), half_up(F.col("n") / F.greatest(most, F.lit(1)), 3).alias("bar"))


def throughput(analyses: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Completed and flagged a day over the last days, each of which has a row."""
    last = F.to_date(F.lit(as_of))
    calendar = analyses.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    day = F.to_date("completed_at")
    facts = analyses.where(day.between(F.date_sub(last, days - 1), last)).groupBy(day.alias("day")).agg(F.count("*").alias("completed"), F.count_if(F.col("verdict").isin(FLAGGED)).alias("flagged"))
    return dense(calendar, facts, ["day"], {"completed": 0, "flagged": 0}).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def feed(analyses: DataFrame, packages: DataFrame, limit: int) -> DataFrame:
    """Flagged packages over all tenants: the worst verdict, with the newest time, once each; worst and newest first."""
    rows = analyses.where(F.col("verdict").isin(FLAGGED) & F.col("completed_at").isNotNull()).withColumn("rank", rank_of(F.col("verdict"), VERDICTS))
    worst = rows.groupBy("package_id").agg(
        F.min("rank").alias("rank"), F.max("completed_at").alias("flagged_at"), F.count("*").alias("sightings"),
        F.min(F.struct("rank", (-micros("completed_at")).alias("t"), (-F.col("analysis_id")).alias("k")))["k"].alias("k"),
    )
    joined = worst.join(packages.select("package_id", "name", "ecosystem"), "package_id")
    return joined.select("package_id", "name", "ecosystem", name_of(F.col("rank"), VERDICTS).alias("verdict"), "flagged_at", "sightings", (-F.col("k")).alias("analysis_id"), "rank").orderBy("rank", F.desc("flagged_at"), "package_id").limit(limit).drop("rank")


def overview(packages: DataFrame, analyses: DataFrame) -> DataFrame:
    """Each package with its latest analysis, its number of them and its worst verdict."""
    sums = analyses.groupBy("package_id").agg(F.count("*").alias("versions"), F.min(rank_of(F.col("verdict"), VERDICTS)).alias("worst"))
    last = latest(analyses, ["package_id"]).select("package_id", F.col("analysis_id").alias("latest_id"), F.col("status").alias("latest_status"), F.col("verdict").alias("latest_verdict"))
    return packages.join(sums, "package_id", "left").join(last, "package_id", "left").select(
        "package_id", "name", "ecosystem", F.coalesce("versions", F.lit(0)).alias("versions"), "latest_id", "latest_status", "latest_verdict", name_of(F.col("worst"), VERDICTS).alias("worst_verdict")
    )


def compare_runs(analyses: DataFrame, hits: DataFrame) -> DataFrame:
    """Rules that each finished analysis of a package has and its predecessor hasn't, and the other way round."""
    order = Window.partitionBy("package_id").orderBy("completed_at", "analysis_id")
    pairs = analyses.where("completed_at is not null").select("package_id", "analysis_id", F.lag("analysis_id").over(order).alias("previous_id")).where("previous_id is not null")
    rules = hits.groupBy("analysis_id").agg(F.collect_set("rule_id").alias("rules"))
    none = F.array().cast("array<string>")
    both = pairs.join(rules, "analysis_id", "left").join(rules.select(F.col("analysis_id").alias("previous_id"), F.col("rules").alias("old")), "previous_id", "left")
    now, old = F.coalesce("rules", none), F.coalesce("old", none)
    joined = lambda x: F.array_join(F.sort_array(x), ",")
    return both.select("package_id", "analysis_id", "previous_id", joined(F.array_except(now, old)).alias("new_rules"), joined(F.array_except(old, now)).alias("resolved_rules"))


def with_any(packages: DataFrame, analyses: DataFrame, hits: DataFrame, family: str) -> DataFrame:
    """Packages that have an analysis with a hit of this family."""
    return packages.join(analyses.join(hits.where(F.col("family") == family), "analysis_id", "left_semi"), "package_id", "left_semi")


def searched(needle: str, limit: int, **kinds: tuple[DataFrame, str, str]) -> DataFrame:
    """One list of hits of several tables: kind, id and text of names that contain the needle, a few of each kind."""
    found = None
    for kind, (df, key, text) in kinds.items():
        part = df.where(F.contains(F.lower(text), F.lit(needle.lower()))).orderBy(text, key).limit(limit).select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        found = part if found is None else found.unionByName(part)
    return found
