import random
import statistics

from quillon.operators import governance, releases


def test_medians():
    rng = random.Random(1)
    m, seen = releases.Median(), []
    assert m.value() is None
    for _ in range(500):
        x = rng.choice([rng.random(), 0.5, 3.0])
        m.put(x)
        seen.append(x)
        assert m.value() == statistics.median(seen)


def test_cadence_against_all_prior_gaps(spark):
    """Ties in time, packages of fewer releases, nulls and a long history."""
    rng = random.Random(2)
    rows = [(p, i, rng.choice([1, 2, 2, 40]) * 3600 * 24) for p in range(12) for i in range(rng.choice([1, 4, 5, 30, 200]))]
    at, timed = {}, []
    for p, i, gap in rows:
        at[p] = at.get(p, 0) + (gap if rng.random() < 0.9 else 0)
        timed.append((p, i, at[p]))
    frame = spark.createDataFrame(timed + [(None, 1, 5), (3, 999, None)], "package_id long, release_id long, s long").selectExpr("package_id", "release_id", "timestamp_seconds(s) AS published_at", "'x' AS at")
    want = []
    for p in at:
        own = sorted((s, i) for q, i, s in timed if q == p)
        gaps = [(b[0] - a[0]) / 86400 for a, b in zip(own, own[1:])]
        for k in range(1, len(gaps)):
            median = statistics.median(gaps[:k])
            if len(own) >= 5 and median > 0 and gaps[k] > 8 * median:
                want.append((p, own[k + 1][1], gaps[k], median))
    got = [(r.package_id, r.release_id, r.gap_days, r.median_days) for r in releases.cadence(frame).collect()]
    assert sorted(got) == sorted(want) and want


def test_runs_against_every_line(spark):
    rng = random.Random(3)
    ranks = ["info", "warning", "error"]
    rows = [(f, s, s + rng.choice([-3, 0, 2, 9, 400]), rng.choice([*ranks, None, "odd"]), f"l{i}", i) for f in range(6) for i in range(rng.choice([0, 1, 25])) for s in [rng.randint(1, 60)]]
    rows += [(9, 5, None, "info", "a", 1), (9, None, 7, "info", "b", 2), (9, 1, 100_000_000, "error", "c", 3), (9, 6, 7, "error", "d", 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "file long, start long, end long, severity string, label string, position long, rank string").repartition(3)
    worst = {}
    for f, s, e, severity, label, position in rows:
        rank = ranks.index(severity or "warning") + 1 if (severity or "warning") in ranks else 0
        if s is not None and rank and f != 9:
            for line in range(s, max(s, e if e is not None else s) + 1):
                worst[f, line] = max(worst.get((f, line), (0, 0, "")), (rank, -position, label))
    lines = governance.line_severity(frame.where("file < 9"), ranks).collect()
    assert sorted((r.file, r.line, r.severity, r.label) for r in lines) == sorted((*k, ranks[w[0] - 1], w[2]) for k, w in worst.items())
    runs = sorted(tuple(r) for r in governance.severity_runs(frame.where("file = 9"), ranks).collect())
    assert runs == [(9, 1, 5, 3, "error", "c"), (9, 6, 7, 3, "error", "d"), (9, 8, 100_000_000, 3, "error", "c")]
    assert governance.severity_runs(frame.limit(0), ranks).collect() == []
