import random

from quillon.sources import registry


def expected(wanted, tags):
    out = []
    for name, version in {w for w in wanted if None not in w}:
        bare = version[1:] if version.startswith("v") else version
        own = {t for n, t in tags if n == name and t is not None}
        exact = [t for t in (before + bare + behind for before, behind in registry.CUSTOMARY) if t in own]
        ends = sorted(t for t in own if any(t.endswith(c + bare) for c in "@-/"))
        if exact or ends:
            out.append((name, version, (exact + ends)[0]))
    return sorted(out)


def test_tags_by_brute_force(spark):
    rnd = random.Random(5)
    parts = ["v", "1", "2", "release-", "releases/", "-release", "@", "-", "/", "", "", "é", "x"]
    text = lambda n: "".join(rnd.choice(parts) for _ in range(n))
    wanted = [(rnd.choice("ab"), text(3)) for _ in range(300)] + [("a", "v"), ("a", ""), ("b", "vv1"), ("a", None), (None, "1"), ("c", "1")]
    tags = [(rnd.choice("ab"), text(4)) for _ in range(1500)] + [("a", ""), ("a", "v"), ("b", "release-"), ("b", None), (None, "v1")]
    frames = spark.createDataFrame(wanted, "name string, version string"), spark.createDataFrame(tags, "name string, tag string")
    got = sorted(tuple(r) for r in registry.resolve_tags(*frames).collect())
    assert got == expected(wanted, tags) and len({t for *_, t in got}) > 20


def test_one_shuffle(spark):
    """Five candidates of each wanted version and all ends of tags were shuffled by joins, and again by version."""
    wanted, tags = spark.range(10).selectExpr("'p' as name", "string(id) as version"), spark.range(10).selectExpr("'p' as name", "concat('v', id) as tag")
    plan = registry.resolve_tags(wanted, tags)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
