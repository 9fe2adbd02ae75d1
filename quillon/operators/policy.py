"""Policies: conjunctions of conditions, of which the first match decides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.core import FAMILIES, VERDICTS, first_per, micros, rank_of


def holds(condition: dict) -> Column:
    """One of the seven kinds of condition, over a subject's columns; null counts as false."""
    kind = condition["type"]
    if kind == "verdict_at_least":
        test = rank_of(F.col("verdict"), VERDICTS) <= VERDICTS.index(condition["verdict"])
    elif kind == "rule_fired":
        test = F.array_contains("fired", condition["rule"])
    elif kind == "family_score_at_least":
        test = F.col("score_" + condition["family"].lower()) >= condition["score"]
    elif kind == "package_age_below_days":
        test = micros("as_of") - micros("first_published") < condition["days"] * 86_400_000_000
    elif kind == "maintainer_count_below":
        test = F.col("maintainers").between(1, condition["count"] - 1)
    elif kind == "license_not_in":
        test = F.col("license").isNull() | ~F.lower(F.trim("license")).isin([x.strip().lower() for x in condition["licenses"]])
    elif kind == "ecosystem_is":
        test = F.col("ecosystem") == condition["ecosystem"]
    else:
        raise ValueError(f"no such condition: {kind}")
    return F.coalesce(test, F.lit(False))


#: The kinds of condition, and what each needs.
KINDS = {
    "verdict_at_least": ("verdict",), "rule_fired": ("rule",), "family_score_at_least": ("family", "score"), "package_age_below_days": ("days",),
    "maintainer_count_below": ("count",), "license_not_in": ("licenses",), "ecosystem_is": ("ecosystem",),
}


def usable(policy: dict) -> tuple[dict, int]:
    """The policy without conditions of unknown kinds or without their values, and how many these are."""
    kept = [c for c in policy["conditions"] if c.get("type") in KINDS and all(c.get(k) is not None for k in KINDS[c["type"]])]
    return {**policy, "conditions": kept}, len(policy["conditions"]) - len(kept)


def described(condition: dict) -> str:
    """A condition in words."""
    c, kind = condition, condition["type"]
    if kind == "verdict_at_least":
        return f"verdict is {c['verdict'].replace('_', ' ').lower()} or worse"
    if kind == "rule_fired":
        return f"rule {c['rule']} fired"
    if kind == "family_score_at_least":
        return f"{c['family'].lower()} score ≥ {c['score']:g}"
    if kind == "package_age_below_days":
        return f"package first published less than {c['days']} days ago"
    if kind == "maintainer_count_below":
        return f"fewer than {c['count']} maintainers"
    if kind == "license_not_in":
        return f"licence not in {', '.join(c['licenses'])}"
    return f"registry is {c['ecosystem']}"


def matches(policy: dict) -> Column:
    """A policy without usable conditions never matches."""
    policy, _ = usable(policy)
    return reduce(lambda a, b: a & b, map(holds, policy["conditions"])) if policy["conditions"] else F.lit(False)


def ordered(policies: list[dict]) -> list[dict]:
    return sorted((p for p in policies if p["enabled"]), key=lambda p: (p["priority"], p["name"]))


def decide(subjects: DataFrame, policies: list[dict]) -> DataFrame:
    """Action, deciding policy and all matching policies of each subject, in one narrow pass."""
    ranked = ordered(policies)
    matched = F.array_compact(F.array(*(F.when(matches(p), F.lit(p["name"])) for p in ranked)))
    action = reduce(lambda c, p: c.when(F.element_at("matched", 1) == p["name"], p["action"]), ranked, F.when(F.size("matched") == 0, "ALLOW"))
    return subjects.withColumn("matched", matched).select(
        "analysis_id", action.alias("action"), F.when(F.size("matched") > 0, F.element_at("matched", 1)).alias("policy"), F.array_join("matched", ",").alias("matched")
    )


#: Analyses that a preview looks at, and matches that it shows.
PREVIEWED, SHOWN = 500, 25


def preview(policy: dict, seen: DataFrame, total: DataFrame) -> DataFrame:
    """One row on what a policy by itself would do to the subjects ``seen``: how many there are, how many match, whether ``total`` (one row, ``total``) has more, and the newest matches with its conditions in words."""
    own, _ = usable(policy)
    newest = F.struct((-micros("completed_at")).alias("t"), (-F.col("analysis_id")).alias("k"), "analysis_id", "verdict")
    # At most PREVIEWED rows.
    sums = seen.agg(F.count("*").alias("evaluated"), F.count_if(matches(policy)).alias("matched"), F.slice(F.array_sort(F.collect_list(F.when(matches(policy), newest))), 1, SHOWN).alias("s"))
    samples = F.transform("s", lambda x: F.struct(x["analysis_id"].alias("analysis_id"), x["verdict"].alias("verdict")))
    reasons = F.array(*(F.lit(described(c)) for c in own["conditions"])).cast("array<string>")
    return sums.crossJoin(F.broadcast(total)).select(F.lit(policy["action"]).alias("action"), "evaluated", "matched", (F.col("total") > F.col("evaluated")).alias("truncated"), F.lit(PREVIEWED).alias("window"), samples.alias("samples"), reasons.alias("reasons"))


def subjects(analyses: DataFrame, hits: DataFrame, rules: DataFrame, packages: DataFrame, releases: DataFrame, as_of: str) -> DataFrame:
    """What policies look at: fired rules, a score for each family (each rule once), and the package with its number of ``maintainers``."""
    once = first_per(hits, ["analysis_id", "rule_id"], F.desc("weight"), F.asc("line"), F.desc("confidence"), F.asc("file_path"), F.desc("modifier")).join(F.broadcast(rules.select("rule_id", "enabled")), "rule_id", "left")
    points = F.when(F.col("enabled"), F.col("weight") * F.col("confidence") * F.col("modifier")).otherwise(0.0)
    sums = once.groupBy("analysis_id").agg(F.collect_set("rule_id").alias("fired"), *(F.sum(F.when(F.col("family") == f, points).otherwise(0.0)).alias("score_" + f.lower()) for f in FAMILIES))
    first = releases.groupBy("package_id").agg(F.min("published_at").alias("first_published"))
    rows = analyses.join(packages.select("package_id", "license", "ecosystem", "maintainers"), "package_id").join(first, "package_id", "left").join(sums, "analysis_id", "left")
    return rows.fillna(0.0, ["score_" + f.lower() for f in FAMILIES]).withColumn("as_of", F.lit(as_of).cast("timestamp_ntz"))


def enforced(decisions: DataFrame, analyses: DataFrame, exceptions: DataFrame, as_of: str) -> DataFrame:
    """A violation for each subject that isn't allowed: EXCEPTED while an exception for its policy or for all is live, else OPEN."""
    live = exceptions.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz"))).where("state = 'APPROVED'")
    rows = decisions.where("action <> 'ALLOW'").join(analyses.select("analysis_id", "package_id", "org_id"), "analysis_id")
    own = live.select("org_id", "package_id", F.col("policy").alias("excepted")).distinct()
    covered = rows.join(own, ["org_id", "package_id"], "left").groupBy("analysis_id", "org_id", "package_id", "policy", "action").agg(F.bool_or(F.coalesce("excepted", F.lit("")) == "*").alias("all"), F.bool_or(F.coalesce(F.col("excepted") == F.col("policy"), F.lit(False))).alias("one"))
    return covered.select("analysis_id", "org_id", "package_id", "policy", "action", F.when(F.col("all") | F.col("one"), "EXCEPTED").otherwise("OPEN").alias("state"), (F.col("action") == "BLOCK").alias("hold"))
