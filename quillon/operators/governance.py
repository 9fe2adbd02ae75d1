"""Lists that people work on: violations, held packages, alerts, audit entries, reports."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.core import combined, in_order
from quillon.operators.relational import latest


def with_optional(df: DataFrame, parent: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with columns of a parent that they may lack; ``key`` is unique there."""
    return df.join(parent.select(key, *columns), key, "left")


def held(violations: DataFrame, analyses: DataFrame) -> DataFrame:
    """(org_id, package_id, policies, violations, verdict): held packages with the names of their open policies and their latest verdict."""
    open_ = violations.where("hold").groupBy("org_id", "package_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("state") == "OPEN", F.col("policy")))), ",").alias("policies"), F.count("*").alias("violations")
    )
    last = latest(analyses, ["package_id"]).select("package_id", "verdict")
    return with_optional(open_, last, "package_id", ["verdict"])


def is_held(df: DataFrame, holds: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``held``: whether its key is among the held ones."""
    marks = holds.select(*keys).distinct().withColumn("held", F.lit(True))
    return df.join(marks, keys, "left").fillna(False, ["held"])


def sweep(violations: DataFrame, exceptions: DataFrame, as_of: str) -> DataFrame:
    """``violations`` after exceptions have expired: excepted ones that no live exception covers any more are open again."""
    at = F.lit(as_of).cast("timestamp_ntz")
    live = exceptions.where("state = 'APPROVED'").where(F.col("expires_at").isNull() | (F.col("expires_at") > at))
    covers = live.select("org_id", "package_id", F.col("policy").alias("by")).distinct()
    keys = ["analysis_id", "policy"]
    excepted = violations.where("state = 'EXCEPTED'")
    kept = excepted.join(covers, ["org_id", "package_id"]).where((F.col("by") == "*") | (F.col("by") == F.col("policy"))).select(*keys, F.lit(True).alias("covered")).distinct()
    state = F.when((F.col("state") == "EXCEPTED") & F.col("covered").isNull(), "OPEN").otherwise(F.col("state"))
    return violations.join(kept, keys, "left").select(*keys, "org_id", "package_id", state.alias("state"), ((F.col("state") == "EXCEPTED") & F.col("covered").isNull()).alias("reopened"))


def alerts(rows: DataFrame, resolved: bool | None) -> DataFrame:
    """All alerts, or only resolved or only unresolved ones, newest first."""
    kept = rows if resolved is None else rows.where(F.col("resolved_at").isNotNull() == F.lit(resolved))
    return kept.orderBy(F.desc("created_at"), F.desc("alert_id"))


def alert_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, and how many are unresolved and unread, whatever filter is on."""
    return rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("resolved_at").isNull()).alias("unresolved"), F.count_if(F.col("read_at").isNull()).alias("unread"))


def facets(df: DataFrame, needle: str, columns: list[str], chosen: dict[str, list]) -> DataFrame:
    """Rows with the needle in one of the columns, whatever its case, and for each facet one of its chosen values."""
    text = F.contains(F.lower(F.concat_ws("\u0000", *columns)), F.lit(needle.lower())) if needle else None
    return df.where(combined(text, *(F.col(c).isin(values) if values else None for c, values in chosen.items())))


def natural(text: Column) -> Column:
    """A sort key: case doesn't count, and runs of digits compare as numbers."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"\d+|\D+"), 0)
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def risk_of(text: Column, verdicts: list[str]) -> Column:
    """A cached risk summary read with tolerance: numbers that are missing count 0, an unknown worst verdict is null, and what isn't a summary is null."""
    names = ["total", "direct", "transitive", "analysed", "unanalysed", "flagged", "blocked"]
    own = F.from_json(text, ", ".join(f"{n} double" for n in names) + ", worstVerdict string, byVerdict map<string,double>")
    counts = F.transform_values(F.coalesce(own["byVerdict"], F.create_map().cast("map<string,double>")), lambda k, v: F.coalesce(v, F.lit(0.0)))
    fields = [F.coalesce(own[n], F.lit(0.0)).cast("long").alias(n) for n in names]
    worst = F.when(own["worstVerdict"].isin(verdicts), own["worstVerdict"]).alias("worst")
    return F.when(own["total"].isNotNull(), F.struct(*fields, worst, F.map_filter(counts, lambda k, v: k.isin(verdicts)).alias("by_verdict")))


def snapshot(title: str, facts: DataFrame, **tables: DataFrame) -> DataFrame:
    """(section, position, payload): a report as JSON rows, first its facts and then each table's rows in their order.

    Tables are the short lists that a report shows; each is ordered and limited before.
    """
    out = facts.select(F.lit("facts").alias("section"), F.lit(0).cast("long").alias("position"), F.to_json(F.struct(F.lit(title).alias("title"), *facts.columns)).alias("payload"))
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("section"), F.monotonically_increasing_id().alias("position"), F.to_json(F.struct(*df.columns)).alias("payload"))
        out = out.unionByName(rows)
    return out


def progress(analyses: DataFrame, stages: list[str]) -> DataFrame:
    """(analysis_id, position, event): what a run reports, as JSON lines: accepted, a line for each stage with the time since the start, and result or error."""
    share = lambda k: (F.col("duration_ms") * (k + 1) / len(stages)).cast("long")
    ok = F.col("status") != "FAILED"
    lines = [
        F.to_json(F.struct(F.lit("accepted").alias("type"), "analysis_id")),
        *(F.to_json(F.struct(F.lit("progress").alias("type"), F.lit(s).alias("stage"), share(k).alias("elapsed_ms"))) for k, s in enumerate(stages)),
        F.to_json(F.struct(F.when(ok, "result").otherwise("error").alias("type"), "status", "verdict")),
    ]
    return analyses.where("completed_at is not null").select("analysis_id", F.posexplode(F.array(*lines)).alias("position", "event"))


def evidence_rows(signals: DataFrame) -> DataFrame:
    """One row for each piece of a signal's ``evidence`` (an array), and a bare one for a signal without any."""
    return signals.select(*(c for c in signals.columns if c != "evidence"), F.explode_outer("evidence").alias("evidence"))


def worst_runs(file, highlights) -> Iterator[tuple]:
    """(file, first, last, rank, label) of the runs of lines of one file that have the same worst highlight, of equal ones the first.

    A sweep over the highlights (file, start, end, rank, position, label) by their
    start, with a heap of those that are open.
    """
    open_, line, run = [], 0, None

    def swept(until: float):
        nonlocal line, run
        while open_ and line < until:
            rank, position, end, label = open_[0]
            if end < line:
                heappop(open_)
                continue
            last = min(end, until - 1)
            if run and run[1] == line - 1 and run[2] == (rank, position, label):
                run[1] = last
            else:
                if run:
                    yield file, run[0], run[1], -run[2][0], run[2][2]
                run = [line, last, (rank, position, label)]
            line = last + 1

    for _, start, end, rank, position, label in highlights:
        yield from swept(start)
        line = start
        heappush(open_, (-rank, position, end, label))
    yield from swept(float("inf"))
    if run:
        yield file, run[0], run[1], -run[2][0], run[2][2]


def severity_runs(highlights: DataFrame, ranks: list[str]) -> DataFrame:
    """(file, first, last, rank, severity, label): runs of lines by their worst highlight (file, start, end, severity, label, position), of equal ones the first.

    An end that is missing or before the start is the start; a missing severity is
    a warning; highlights without a start, or of an unknown severity, mark nothing.
    """
    end = F.greatest(F.col("start"), F.coalesce("end", F.col("start")))
    rank = F.array_position(F.array(*map(F.lit, ranks)), F.coalesce("severity", F.lit("warning"))).cast("long")
    rows = highlights.select(F.col("file").cast("long").alias("file"), F.col("start").cast("long"), end.cast("long").alias("end"), rank.alias("rank"), F.coalesce(F.col("position").cast("long"), F.lit(0)).alias("position"), F.coalesce("label", F.lit("")).alias("label"))
    runs = in_order(rows.where("start IS NOT NULL AND rank > 0"), "file", ["start", "position"], worst_runs, "file long, first long, last long, rank long, label string")
    return runs.select("file", "first", "last", "rank", F.element_at(F.array(*map(F.lit, ranks)), F.col("rank").cast("int")).alias("severity"), "label")


def line_severity(highlights: DataFrame, ranks: list[str]) -> DataFrame:
    """(file, line, severity, label): the worst highlight of each line; a row for each line, so only for files that are shown."""
    return severity_runs(highlights, ranks).select("file", F.explode(F.sequence("first", "last")).alias("line"), "severity", "label")


def largest(files: DataFrame, n: int) -> DataFrame:
    """The n largest files of each package, those that a parser would be given."""
    from quillon.functions.core import top_per

    return top_per(files, ["package"], n, F.desc("size"), F.asc("path"))


def variant_quality(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """(variant, true_positives, false_positives, missed, precision, recall) of rule variants (variant, package) over labelled packages (package, bad); each package counts once."""
    told = hits.select("variant", "package").distinct().join(labels, "package")
    bad = labels.agg(F.count_if("bad").alias("bad"))  # one row
    sums = told.groupBy("variant").agg(F.count_if("bad").alias("true_positives"), F.count_if(~F.col("bad")).alias("false_positives")).crossJoin(F.broadcast(bad))
    tp, fp = F.col("true_positives"), F.col("false_positives")
    return sums.select("variant", tp, fp, (F.col("bad") - tp).alias("missed"), (tp / (tp + fp)).alias("precision"), F.when(F.col("bad") > 0, tp / F.col("bad")).alias("recall"))
