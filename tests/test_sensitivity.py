import random
from itertools import combinations

from quillon.functions.core import THRESHOLDS, VERDICTS
from quillon.operators import intervals, sensitivity
from quillon.operators.scoring import TRIGGERS


def rank(points, rules):
    scored = sensitivity.rank_of_score(sum(points[r] for r in rules))
    forced = any(all(set(g) & set(rules) for g in groups) for groups in TRIGGERS.values())
    return min(scored, 1) if forced else scored


def test_minimal_sets():
    assert sensitivity.minimal_sets([["a", "b"], ["a"], ["c"]]) == [frozenset("ac")]
    assert sensitivity.minimal_sets([["a", "b"], ["c", "d"]]) == [frozenset("ac"), frozenset("ad"), frozenset("bc"), frozenset("bd")]


def test_against_all_subsets(spark):
    """Every subset of the fired rules, and every set of further ones, is tried."""
    rng = random.Random(9)
    every = sorted({r for groups in TRIGGERS.values() for g in groups for r in g})
    cases = [(k, {r: float(rng.choice([1, 4, 9, 26, 60])) for r in rng.sample([*every, "Q-MNT-001", "Q-TYP-002"], rng.randint(0, 7))}) for k in range(60)]
    analyses = spark.createDataFrame([(k,) for k, _ in cases] + [(1000,)], "analysis_id long")
    hits = spark.createDataFrame([(k, r, p, 1, 1.0, 1, 1.0) for k, own in cases for r, p in own.items()], "analysis_id long, rule_id string, weight double, line long, confidence double, file_path long, modifier double")
    rules = spark.createDataFrame([(r, True) for r in [*every, "Q-MNT-001", "Q-TYP-002"]], "rule_id string, enabled boolean")
    got = {r.analysis_id: r for r in sensitivity.sensitivity(analyses, hits, rules).collect()}
    assert len(got) == 61 and (got[1000].verdict, got[1000].down) == ("CLEAN", None)
    for k, points in cases:
        own = rank(points, points)
        down = next((n for n in range(len(points) + 1) if any(rank(points, set(points) - set(gone)) > own for gone in combinations(points, n))), None) if own < len(THRESHOLDS) else None
        free = dict.fromkeys(every, 0.0) | points
        up = next(n for n in range(4) if any(rank(free, {*points, *more}) <= 1 for more in combinations([r for r in every if r not in points], n))) if own > 1 else None
        assert (got[k].verdict, got[k].down, got[k].up) == (VERDICTS[own], down, up), points


def test_points_in_ranges(spark):
    rng = random.Random(4)
    points = [(rng.randint(0, 2), rng.randint(-50, 300)) for _ in range(200)] + [(1, None), (None, 5)]
    ranges = [(rng.randint(0, 2), s, s + rng.choice([-1, 0, 3, 150]), i) for i, s in enumerate(rng.randint(-60, 280) for _ in range(80))] + [(None, 0, 10, 900), (1, None, 4, 901)]
    left, right = spark.createDataFrame(points, "k long, at long"), spark.createDataFrame(ranges, "k long, s long, e long, id long")
    want = sorted((k, at, i) for k, at in points for kk, s, e, i in ranges if k is not None and k == kk and at is not None and s is not None and s <= at <= e)
    for width in (1, 16, 1000):
        assert sorted((r.k, r.at, r.id) for r in intervals.inside(left, right, ["k"], "at", "s", "e", width).collect()) == want
