"""How little would have to change for an analysis to get another verdict."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.core import THRESHOLDS, VERDICTS, in_order, name_of
from quillon.operators.scoring import TRIGGERS, fired_rules


def minimal_sets(groups: list[list[str]]) -> list[frozenset[str]]:
    """The least sets with a member of each group: the product of the groups, less those that contain another."""
    sets = {frozenset(choice) for choice in product(*groups)}
    return sorted((s for s in sets if not any(x < s for x in sets)), key=lambda s: (len(s), sorted(s)))


#: (trigger, least set) of all triggers.
SATISFYING = [(t, s) for t in sorted(TRIGGERS) for s in minimal_sets(TRIGGERS[t])]


def rank_of_score(score: float) -> int:
    return next((k for k, least in enumerate(THRESHOLDS) if score >= least), len(THRESHOLDS))


def breaking_sets(fired: set[str]) -> list[frozenset[str]]:
    """Least sets of fired rules without which no trigger holds: of each that holds, the fired rules of one group."""
    held = [[frozenset(fired.intersection(g)) for g in groups] for groups in TRIGGERS.values() if all(fired.intersection(g) for g in groups)]
    sets = {frozenset().union(*choice) for choice in product(*held)}
    return [s for s in sets if not any(x < s for x in sets)]


def weaker(points: dict[str, float], most: float, least: int) -> int:
    """How many rules have to go, the heaviest first, until what is left is below ``most``; at least ``least`` are gone already."""
    left, n = sum(points.values()), least
    for value in sorted(points.values(), reverse=True):
        if left < most:
            break
        left, n = left - value, n + 1
    return n


def nearest(analysis, rows) -> Iterator[tuple]:
    """(analysis_id, rank, up, trigger, down) of one analysis from its fired rules (analysis_id, rule_id, points)."""
    points = {rule: value for _, rule, value in rows if rule is not None}
    fired, scored = set(points), rank_of_score(sum(points.values()))
    forced = any(s <= fired for _, s in SATISFYING)
    rank = min(scored, 1) if forced else scored
    up, trigger = min((len(s - fired), t) for t, s in SATISFYING) if rank > 1 else (None, None)
    down = None
    if rank == 0:
        down = weaker(points, THRESHOLDS[0], 0)
    elif rank < len(THRESHOLDS):
        down = min(weaker({r: v for r, v in points.items() if r not in gone}, THRESHOLDS[rank], len(gone)) for gone in breaking_sets(fired))
    yield analysis, rank, up, trigger, down


def sensitivity(analyses: DataFrame, hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(analysis_id, verdict, up, trigger, down) of every analysis, by score and triggers.

    ``up``: the fewest further rules with which a trigger holds, and that trigger
    (the first by name of several), for verdicts that a trigger would worsen.
    ``down``: the fewest fired rules without which the verdict is better; null for
    the best one. Rules that are switched off or unknown score nothing but count
    for triggers; analyses without a hit have no rule to lose.
    """
    fired = fired_rules(hits).join(F.broadcast(rules.select("rule_id", "enabled")), "rule_id", "left")
    points = F.when(F.col("enabled"), F.col("weight") * F.col("confidence") * F.col("modifier")).otherwise(0.0)
    rows = analyses.select(F.col("analysis_id").cast("long")).join(fired.select("analysis_id", "rule_id", points.cast("double").alias("points")), "analysis_id", "left")
    told = in_order(rows, "analysis_id", ["rule_id"], nearest, "analysis_id long, rank int, up int, trigger string, down int")
    return told.select("analysis_id", name_of(F.col("rank"), VERDICTS).alias("verdict"), "up", "trigger", "down")
