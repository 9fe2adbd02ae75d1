"""From rule hits to a verdict for each analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.core import SEVERITIES, VERDICTS, bucket_rank, first_per, half_up, name_of, parts_of, rank_of

#: Each trigger holds when, of every group, at least one rule has fired.
TRIGGERS = {
    "install-network-exfil": [["Q-INS-001"], ["Q-INS-005"]],
    "install-credential-read": [["Q-INS-001"], ["Q-INS-004"]],
    "install-decoded-payload": [["Q-INS-001"], ["Q-INS-003"], ["Q-INS-002", "Q-OBF-003"]],
    "tarball-only-executable": [["Q-PRV-003"]],
    "exfil-endpoint-with-credentials": [["Q-CAP-005", "Q-CAP-006"], ["Q-CAP-008"]],
    "obfuscated-exec-with-exfil": [["Q-OBF-003", "Q-OBF-004"], ["Q-CAP-001"], ["Q-CAP-002"]],
    "trojan-source": [["Q-OBF-005"]],
}
TRIGGER_RULES = sorted({r for groups in TRIGGERS.values() for g in groups for r in g})
#: Least and greatest confidence, gain for each further family, loss for each incomplete stage, and what holds without a hit.
LEAST, MOST, GAIN, LOSS, UNFIRED = 0.1, 1.0, 0.08, 0.12, 0.9


def first_hit() -> tuple[Column, ...]:
    """Of a rule's hits the first one in this total order counts."""
    return F.desc("weight"), F.asc("line"), F.desc("confidence"), F.asc("file_path"), F.desc("modifier")


def fired_rules(hits: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each analysis and rule: its first hit. All hits of an analysis come together, so what follows by analysis needs no more shuffles."""
    return first_per(hits.repartition(parts or parts_of(hits), "analysis_id"), ["analysis_id", "rule_id"], *first_hit())


def column_of(rule_id: str) -> str:
    return "fired_" + rule_id[2:].replace("-", "_").lower()


def holds(groups: list[list[str]]) -> Column:
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [F.col(column_of(r)) for r in g]) for g in groups])


def scorecard(analyses: DataFrame, hits: DataFrame, rules: DataFrame, known_bad: DataFrame | None = None, skipped: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """Score, triggers, confidence and verdict of every analysis, with or without hits.

    Rules that are switched off or unknown score nothing, but fired ones still
    count for triggers. ``known_bad`` has analysis ids whose archive is known,
    ``skipped`` (analysis_id, rule_id) of rules that couldn't be judged, and
    ``failed`` (analysis_id, family) of families that were not examined; each
    family counts as an incomplete stage. Without it a partial analysis has one.
    """
    n = parts_of(hits)
    fired = fired_rules(hits, n).join(F.broadcast(rules.select("rule_id", "enabled")), "rule_id", "left")
    flags = [F.bool_or(F.col("rule_id") == r).alias(column_of(r)) for r in TRIGGER_RULES]
    sums = fired.groupBy("analysis_id").agg(
        F.sum(F.when(F.col("enabled"), F.col("weight") * F.col("confidence") * F.col("modifier")).otherwise(0.0)).alias("total"),
        F.avg("confidence").alias("mean_confidence"), F.countDistinct("family").alias("families"), F.count("*").alias("rules_fired"), *flags,
    )
    rows = analyses.repartition(n, "analysis_id").join(sums, "analysis_id", "left").fillna(False, [column_of(r) for r in TRIGGER_RULES]).fillna(0, ["total", "rules_fired", "families"])
    names = F.array_compact(F.array(*(F.when(holds(g), F.lit(t)) for t, g in sorted(TRIGGERS.items()))))
    loss = F.when(F.col("status") == "PARTIAL", LOSS).otherwise(0.0)
    if failed is not None:
        rows = rows.join(failed.groupBy("analysis_id").agg(F.countDistinct("family").alias("stages")), "analysis_id", "left")
        loss = LOSS * F.coalesce("stages", F.lit(0))
    if skipped is not None:
        # A rule of a failed family isn't among those that were asked.
        asked = skipped.select("analysis_id", "rule_id").distinct().join(hits.select("analysis_id", "rule_id").distinct(), ["analysis_id", "rule_id"], "left_anti")
        rows = rows.join(asked.groupBy("analysis_id").agg(F.count("*").alias("skips")), "analysis_id", "left")
        loss = loss + LOSS * F.coalesce("skips", F.lit(0)) / rules.count()  # 41 rows
    confidence = F.when(F.col("rules_fired") == 0, UNFIRED - loss).otherwise(F.col("mean_confidence") + GAIN * (F.col("families") - 1) - loss)
    rows = rows.withColumn("triggers", names).withColumn("scored", bucket_rank(F.col("total")))
    forced = F.size("triggers") > 0
    verdict = F.when(forced, F.least("scored", F.lit(1))).otherwise(F.col("scored"))
    decided = F.when(forced & (F.col("scored") > 1), "hard-trigger").otherwise("weighted-score")
    sure = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), confidence))
    if known_bad is not None:
        bad = F.col("_bad").isNotNull()
        rows = rows.join(known_bad.select("analysis_id", F.lit(True).alias("_bad")).distinct(), "analysis_id", "left")
        verdict, decided, sure = F.when(bad, 0).otherwise(verdict), F.when(bad, "known-bad-hash").otherwise(decided), F.when(bad, MOST).otherwise(sure)
    return rows.select(
        "analysis_id", "org_id", half_up(F.col("total"), 4).alias("score"), F.array_join("triggers", ",").alias("triggers"), F.col("rules_fired").cast("long").alias("rules_fired"),
        half_up(sure, 4).alias("confidence"), name_of(verdict, VERDICTS).alias("verdict"), decided.alias("decided_by"),
    )


def trigger_hits(hits: DataFrame) -> DataFrame:
    """(analysis_id, trigger) of the triggers that hold."""
    flags = hits.where(F.col("rule_id").isin(TRIGGER_RULES)).groupBy("analysis_id").agg(*(F.bool_or(F.col("rule_id") == r).alias(column_of(r)) for r in TRIGGER_RULES))
    names = F.array_compact(F.array(*(F.when(holds(g), F.lit(t)) for t, g in TRIGGERS.items())))
    return flags.select("analysis_id", F.explode(names).alias("trigger"))


def load_bearing(hits: DataFrame) -> DataFrame:
    """(analysis_id, trigger, rules) with the rules a trigger rests on.

    A rule is necessary when its group has no other fired rule. Where no rule is,
    the trigger rests on the fired rules without whose whole family it fails.
    """
    rows = [(t, k, r, r[:5]) for t, groups in TRIGGERS.items() for k, g in enumerate(groups) for r in g]
    parts = hits.sparkSession.createDataFrame(rows, "trigger string, part int, rule_id string, prefix string")
    used = hits.select("analysis_id", "rule_id").distinct().join(F.broadcast(parts), "rule_id").join(trigger_hits(hits), ["analysis_id", "trigger"])
    groups = used.groupBy("analysis_id", "trigger", "part").agg(F.collect_set("rule_id").alias("rules"), F.countDistinct("prefix").alias("prefixes"))
    whole = groups.groupBy("analysis_id", "trigger").agg(
        F.sort_array(F.flatten(F.collect_list(F.when(F.size("rules") == 1, F.col("rules"))))).alias("necessary"),
        F.sort_array(F.flatten(F.collect_list(F.when(F.col("prefixes") == 1, F.col("rules"))))).alias("families"),
    )
    return whole.select("analysis_id", "trigger", F.array_join(F.when(F.size("necessary") > 0, F.col("necessary")).otherwise(F.col("families")), ",").alias("rules"))


def weighed(signals: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(package, score, worst, rules) of detection signals (package, rule_id, confidence) by a catalogue's weights: each rule once, at its greatest confidence; unknown rules weigh nothing."""
    once = signals.groupBy("package", "rule_id").agg(F.max("confidence").alias("confidence"))
    rows = once.join(F.broadcast(catalogue.select("rule_id", "weight", "severity")), "rule_id", "left")
    worst = F.min(rank_of(F.col("severity"), SEVERITIES))
    sums = rows.groupBy("package").agg(F.sum(F.coalesce(F.col("weight") * F.col("confidence"), F.lit(0.0))).alias("score"), worst.alias("worst"), F.count("*").alias("rules"))
    return sums.select("package", half_up(F.col("score"), 4).alias("score"), name_of(F.col("worst"), SEVERITIES).alias("worst"), "rules")


def rule_stats(hits: DataFrame, analyses: DataFrame) -> DataFrame:
    """(rule_id, hits, analyses, packages, benign): hits on known analyses, and distinct analyses, packages and benign analyses.

    Hits are counted for each analysis and rule, then for each package and rule,
    so that distinct ones are rows of a step and no row is kept once for each
    count. An analysis of several rows counts with the first of them.
    """
    own = Window.partitionBy("analysis_id")
    first, benign = F.row_number().over(own.orderBy("package_id")) == 1, F.max(F.coalesce(F.col("verdict").isin("CLEAN", "LOW_RISK"), F.lit(False))).over(own)
    n = parts_of(hits)
    dealt = analyses.select("analysis_id", "package_id", "verdict").repartition(n, "analysis_id")
    known = dealt.select("analysis_id", "package_id", first.cast("int").alias("one"), (first & benign).cast("int").alias("benign"))
    fired = hits.select("analysis_id", "rule_id").repartition(n, "analysis_id").groupBy("analysis_id", "rule_id").agg(F.count("*").alias("hits"))
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    of_package = fired.join(known, "analysis_id").select("package_id", "rule_id", "hits", "one", "benign").repartition(n, "package_id", "rule_id")
    rows = of_package.groupBy("package_id", "rule_id").agg(*sums("hits", "one", "benign"))
    return rows.groupBy("rule_id").agg(F.sum("hits").alias("hits"), F.sum("one").alias("analyses"), F.count("package_id").alias("packages"), F.sum("benign").alias("benign"))


def signal_counts(hits: DataFrame, families: list[str]) -> DataFrame:
    """Distinct fired rules of each of the families, for each analysis: one shuffle, and no row once for each family."""
    once = hits.select("analysis_id", "family", "rule_id").repartition(parts_of(hits), "analysis_id").distinct()
    return once.groupBy("analysis_id").agg(*(F.count(F.when(F.col("family") == f, F.col("rule_id"))).alias(f.lower()) for f in families))


def family_breakdown(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Each analysis and family: rules in force, rules fired, contribution once a rule, worst severity; families without a hit too."""
    fired = fired_rules(hits).join(F.broadcast(rules.select("rule_id", "enabled")), "rule_id")
    worst = F.min(rank_of(F.col("severity"), SEVERITIES))
    sums = fired.groupBy("analysis_id", "family").agg(
        F.count("*").alias("rules_fired"), F.sum(F.when(F.col("enabled"), F.col("weight") * F.col("confidence") * F.col("modifier")).otherwise(0.0)).alias("contribution"), worst.alias("worst")
    )
    families = rules.groupBy("family").agg(F.count_if("enabled").alias("rules_enabled"))
    grid = hits.select("analysis_id").distinct().crossJoin(F.broadcast(families))  # a row for each of the six families
    return grid.join(sums, ["analysis_id", "family"], "left").select(
        "analysis_id", "family", "rules_enabled", F.coalesce("rules_fired", F.lit(0)).alias("rules_fired"),
        half_up(F.coalesce("contribution", F.lit(0.0)), 2).alias("contribution"), name_of(F.col("worst"), SEVERITIES).alias("worst_severity"),
    )


def file_risk(hits: DataFrame, rules: DataFrame, longest: int = 500) -> DataFrame:
    """Each analysis and file: rules, families, risk once a rule, worst severity, and distinct flagged lines.

    Lines are counted from intervals, without a row for each line: in the order
    of their starts, an interval adds what lies beyond the greatest end so far.
    """
    keys = ["analysis_id", "file_path"]
    once = first_per(hits, [*keys, "rule_id"], *first_hit()).join(F.broadcast(rules.select("rule_id", "enabled")), "rule_id")
    sums = once.groupBy(*keys).agg(
        F.count("*").alias("rules"), F.countDistinct("family").alias("families"),
        F.sum(F.when(F.col("enabled"), F.col("weight") * F.col("confidence") * F.col("modifier")).otherwise(0.0)).alias("risk"),
    )
    until = F.least(F.col("line_end"), F.col("line_start") + longest - 1)
    before = F.max(until).over(Window.partitionBy(*keys).orderBy("line_start", until).rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(until - F.greatest(F.col("line_start"), F.coalesce(before + 1, F.col("line_start"))) + 1, F.lit(0))
    spans = hits.select(*keys, new.alias("new"), rank_of(F.col("severity"), SEVERITIES).alias("rank"))
    whole = spans.groupBy(*keys).agg(F.sum("new").alias("flagged_lines"), F.min("rank").alias("worst"))
    return sums.join(whole, keys).select(*keys, "rules", "families", half_up(F.col("risk"), 2).alias("risk"), name_of(F.col("worst"), SEVERITIES).alias("worst_severity"), "flagged_lines")
