"""Hits are dealt out by analysis into parts of bounded rows, without a row for each count."""

import contextlib
import io

from quillon.functions.core import parts_of
from quillon.operators import scoring
from quillon.plans import registry


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_parts_follow_rows(spark):
    assert parts_of(spark.range(1001), 10) == 101 and parts_of(spark.range(0), 10) == spark.sparkContext.defaultParallelism


def test_rule_stats_counts_distinct_ones(spark):
    hits = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "a"), (4, "b"), (9, "a"), (None, "a")]
    known = [(1, 7, "CLEAN"), (2, 7, "SUSPICIOUS"), (3, 8, None), (4, 8, "LOW_RISK"), (4, 9, "SUSPICIOUS"), (5, 5, "CLEAN")]
    got = scoring.rule_stats(spark.createDataFrame(hits, "analysis_id long, rule_id string"), spark.createDataFrame(known, "analysis_id long, package_id long, verdict string")).collect()
    want = {}
    for a, r in hits:
        for b, p, v in known:
            if a == b:
                want.setdefault(r, []).append((a, p, v in ("CLEAN", "LOW_RISK")))
    assert {r.rule_id: (r.hits, r.analyses, r.packages, r.benign) for r in got} == {r: (len(x), len({a for a, _, _ in x}), len({p for _, p, _ in x}), len({a for a, _, b in x if b})) for r, x in want.items()}


def test_rule_stats_keeps_no_row_for_each_count(spark, sf_dir):
    assert "Expand" not in plan(registry.QUERIES["rule_stats"](spark, sf_dir))


def test_scorecard_shuffles_hits_once(spark, sf_dir):
    told = plan(registry.QUERIES["verdict_scorecard"](spark, sf_dir))
    assert "hashpartitioning(analysis_id#" in told and ", rule_id#" not in "".join(x for x in told.splitlines() if "Exchange" in x) and told.count("REPARTITION_BY_NUM") == 2


def test_signal_counts_shuffle_once(spark, sf_dir):
    for name in ("signal_counts_all", "signal_counts"):
        told = plan(registry.QUERIES[name](spark, sf_dir))
        assert "Expand" not in told and told.count("Exchange") == 1
