"""Signals, governance and small functions that no query reaches in full."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from quillon.functions import coordinates as K
from quillon.operators import campaigns, changes, exports, graph, limits, policy, signals, text_rules
from quillon.operators import governance as V
from quillon.plans import registry
from quillon.sources.registry import resolve_tags
from quillon.sources.views import rule
from quillon.streaming import limits as streams

POPULAR = [("express", 9_000_000), ("cross-env", 5_000_000), ("@types/node", 8_000_000), ("lodash", 7_000_000)]


def test_name_signals(spark):
    popular = spark.createDataFrame(POPULAR, "name string, downloads long")
    rows = [
        (1, "expres", "x", 10), (2, "crossenv", "x", 10), (3, "types-node", "x", 10), (4, "@typess/node", "x", 10), (5, "lodashjs", "x", 10), (6, "corp-thing", "x", 10), (7, "ехpress", "x", 10),
        (8, "zqxjkvwmpb-tool", "fine", None), (9, "express", "x", 9_000_000), (10, "expresss", "x", 30_000), (11, "ünlike", "Do not use", 1), (12, "expres", "x", 900_001),
    ]
    packages = spark.createDataFrame(rows, "package long, name string, description string, downloads long")
    got = {(r.package, r.rule_id): r for r in signals.name_signals(packages, popular).collect()}
    fired = {p: sorted(r for q, r in got if q == p) for p in range(1, 13)}
    assert fired[1] == ["Q-TYP-001"] and got[1, "Q-TYP-001"].confidence == 0.85 and got[1, "Q-TYP-001"].detail == "express"
    assert fired[2] == ["Q-TYP-003"] and "Q-TYP-004" in fired[3] and "Q-TYP-004" in fired[4] and "Q-TYP-005" in fired[5] and fired[6] == ["Q-TYP-006"]
    assert "Q-TYP-002" in fired[7] and got[7, "Q-TYP-002"].confidence == 0.95 and fired[8] == [] and fired[9] == [] and fired[10] == []
    assert fired[11] == ["Q-TYP-002", "Q-TYP-006"] and got[11, "Q-TYP-002"].confidence == 0.5
    dense = signals.dense(packages.select("package"), signals.name_signals(packages, popular).drop("detail"), rule(spark)).collect()
    assert len(dense) == 12 * 41 and sum(r.fired for r in dense) == len(got)
    assert all(r.skipped == "NOT_APPLICABLE" for r in dense if r.rule_id in ("Q-MNT-004", "Q-PRV-006"))


def test_account_signals(spark):
    at = datetime(2026, 1, 1)
    packages = spark.createDataFrame([(1, at, 200_000), (2, at, None), (3, at, 99_999), (4, at, 5), (5, at, 5)], "package long, published_at timestamp, downloads long")
    people = [(1, "a", None, None), (2, "b", datetime(2025, 10, 3), None), (2, "c", datetime(2020, 1, 1), None), (3, "d", None, 3), (4, "e", datetime(2025, 10, 2), 4)]
    got = {(r.package, r.rule_id): (r.confidence, r.skipped, r.detail) for r in signals.account_signals(packages, spark.createDataFrame(people, "package long, name string, created_at timestamp, packages int")).collect()}
    assert got == {
        (1, "Q-MNT-003"): (None, "NO_METADATA", None), (1, "Q-MNT-004"): (0.6, None, None), (2, "Q-MNT-003"): (0.7, None, "b"), (2, "Q-MNT-004"): (None, "NO_DOWNLOAD_DATA", None), (3, "Q-MNT-003"): (0.7, None, "d"),
        (5, "Q-MNT-003"): (None, "NO_METADATA", None),
    }


def test_source_signals(spark):
    packages = [(1, None, True, False, False), (2, "u", False, False, True), (3, "u", True, True, True), (4, "u", True, False, True), (5, "u", True, False, True), (6, "u", True, False, True), (7, "u", True, False, True)]
    frame = spark.createDataFrame(packages, "package long, repository_url string, readable boolean, archived boolean, attested boolean")
    files = [(3, "a.js", "IDENTICAL"), (3, "b.js", "MODIFIED"), (4, "drop.js", "ONLY_PACKAGED"), (4, "a.js", "IDENTICAL"), (5, "drop.js", "ONLY_PACKAGED"), (5, "a.js", "IDENTICAL")]
    files += [(6, f"{i}.txt", "ONLY_PACKAGED") for i in range(3)] + [(7, f"{i}.js", "ONLY_PACKAGED") for i in range(6)] + [(7, f"same{i}.js", "IDENTICAL") for i in range(5)]
    trees = spark.createDataFrame(files, "package long, path string, status string")
    from quillon.operators.provenance import builds

    source = spark.createDataFrame([(5, "src/a.ts"), (4, "types.d.ts"), (4, "lib/a.js")], "package long, path string")
    blobs = spark.createDataFrame([(2, "x.node", 20_000, True), (2, "x.png", 20_000, True), (6, "y.so", 20_000, False), (6, "binding.gyp", 10, False), (7, "z.dll", 100, True), (1, "i.png", 10**6, True)], "package long, path string, size long, is_binary boolean")
    declared = spark.createDataFrame([(2, ["express"], ["web"]), (6, [], [])], "package long, dependencies array<string>, keywords array<string>")
    found = signals.source_signals(frame, trees, builds(source), signals.undeclared_blobs(blobs, declared))
    got = {(r.package, r.rule_id[-1]): r.confidence if r.skipped is None else r.skipped for r in found.collect()}
    assert got == {
        (1, "1"): 0.95, (1, "2"): "NO_REPO", (1, "3"): "NO_REPO", (1, "4"): "NO_REPO", (1, "6"): 0.9, (2, "2"): 0.75, (2, "3"): "REPO_UNREACHABLE", (2, "4"): "REPO_UNREACHABLE", (2, "5"): 0.8,
        (3, "2"): 0.6, (3, "4"): 0.65, (4, "3"): 0.95, (5, "3"): "BUILD_OUTPUT", (6, "3"): 0.6, (6, "4"): "NO_TAG_MATCH", (7, "3"): "BUILD_OUTPUT",
    }
    states = {r.package: r.status for r in signals.source_status(found).collect()}
    assert states == {1: "NO_REPO", 2: "REPO_UNREACHABLE", 3: "DIVERGENT", 4: "DIVERGENT", 5: "MATCH", 6: "DIVERGENT", 7: "MATCH"}


def test_indicators(spark):
    evm, btc, tron = "0x" + "Ab" * 20, "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "TJRyWwFs9wTFGZg3JbrVriFbNfCug5tDeC"
    rows = [
        (1, "Q-CAP-008", f"post https://Evil.example:8443/x and https://github.com/a {evm}", None, None, None, "SUSPICIOUS"), (2, "Q-CAP-007", None, "8.8.8.8", None, None, "LIKELY_MALICIOUS"),
        (3, "Q-CAP-009", None, None, "A" * 64, None, "KNOWN_MALICIOUS"), (4, "Q-MNT-002", f"{btc} {tron}", None, None, "Mallory", "SUSPICIOUS"), (5, "Q-MNT-004", None, None, None, "solo", "SUSPICIOUS"),
        (6, "Q-CAP-008", "https://evil.example/", None, None, None, "LOW_RISK"), (7, "Q-MNT-003", None, None, None, "unknown", "SUSPICIOUS"),
    ]
    hits = spark.createDataFrame(rows, "member long, rule_id string, excerpt string, address string, sha256 string, maintainer string, verdict string").withColumns({"confidence": F.lit(0.9), "seen": F.lit("2026-01-01").cast("timestamp")})
    got = {(r.member, r.type, r.value) for r in campaigns.indicators(hits).collect()}
    assert got == {(1, "EXFIL_ENDPOINT", "evil.example"), (1, "WALLET", evm.lower()), (2, "EXFIL_ENDPOINT", "8.8.8.8"), (3, "CODE_HASH", "a" * 64), (4, "WALLET", btc), (4, "WALLET", tron), (4, "MAINTAINER", "mallory")}


def test_policies_with_unknown_conditions():
    own, dropped = policy.usable({"name": "p", "conditions": [{"type": "odd"}, {"type": "rule_fired"}, {"type": "rule_fired", "rule": "Q-INS-001"}]})
    assert dropped == 2 and [policy.described(c) for c in own["conditions"]] == ["rule Q-INS-001 fired"]
    assert policy.described({"type": "family_score_at_least", "family": "CAPABILITY", "score": 12.0}) == "capability score ≥ 12"


def test_graph_orphans(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7)], "parent long, child long")
    tree = graph.paths(graph.depths(edges, graph.roots(edges)))
    rows = {r.node: (r.depth, r.path) for r in graph.with_orphans(tree, edges.selectExpr("child AS node")).collect()}
    assert rows == {1: (0, []), 2: (1, [1]), 3: (2, [1, 2]), 7: (1, []), 8: (1, [])}
    assert sorted(r.node for r in graph.at_depth(tree, 1).collect()) == [1, 2]
    told = tree.withColumn("verdict", F.when(F.col("node") > 1, "SUSPICIOUS"))
    assert graph.risk_by_verdict(told, spark.createDataFrame([(2,), (2,)], "node long")).first().asDict() == {"blocked": 1, "known_malicious": 0, "likely_malicious": 0, "suspicious": 2, "low_risk": 0, "clean": 0}


def test_texts(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(exports.slug(F.lit("Ünï  Cødé"))) == "u-ni-c-de" and value(exports.slug(F.lit("A!"))) == "org-a"
    assert value(exports.uuid_of(F.lit("clx9"))).split("-")[1:] == ["c009", "4000", "8000", "000000000000"] and len(value(exports.uuid_of(F.lit("x" * 30)))) == 36
    assert value(K.looks_encoded(F.lit("plain words"))) is False and all(value(K.looks_encoded(F.lit(t))) for t in ("", "deadbeef01", "é", "12-34", "QUJDREVGR0hJSktM"))
    assert value(K.bounded_list(F.array(F.lit(""), F.lit("abc"), F.lit(None), F.lit("d")), 1, 2)) == ["ab"] and value(K.bounded_list(F.lit(None).cast("array<string>"))) == []
    assert value(K.bounded_record(F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit(None).cast("string")))) == {"a": "x"} and value(K.bounded_text(F.lit(""))) is None
    assert value(K.decoded_segment(F.lit("a%2Fb+c"))) == "a/b+c" and value(K.decoded_segment(F.lit("%zz"))) == "%zz"
    assert value(text_rules.context(F.lit("a Vite plugin for React"))) == "BUILD_TOOL" and value(text_rules.context(F.lit("x"), F.lit(500))) == "FRAMEWORK"
    assert [value(limits.disabled(F.lit(n))) for n in (9, 10)] == [False, True]


def test_tags(spark):
    wanted = spark.createDataFrame([("a", "v1.0.0"), ("b", "1.0.0"), ("c", "2.0-rc"), ("d", "1.0.0")], "name string, version string")
    tags = [("a", "1.0.0"), ("a", "v1.0.0"), ("b", "x@1.0.0"), ("b", "pkg/1.0.0"), ("c", "c-2.0-rc"), ("d", "11.0.0")]
    got = {r.name: r.tag for r in resolve_tags(wanted, spark.createDataFrame(tags, "name string, tag string")).collect()}
    assert got == {"a": "v1.0.0", "b": "pkg/1.0.0", "c": "c-2.0-rc"}


def test_reports_and_events(spark, tmp_path):
    runs = spark.createDataFrame([(1, "COMPLETED", "CLEAN", 100, "2026-01-01"), (2, "FAILED", None, 50, "2026-01-01"), (3, "QUEUED", None, None, None)], "analysis_id long, status string, verdict string, duration_ms long, completed_at string")
    lines = [json.loads(r.event) for r in V.progress(runs, ["fetch", "score"]).orderBy("analysis_id", "position").collect()]
    assert [x["type"] for x in lines] == ["accepted", "progress", "progress", "result", "accepted", "progress", "progress", "error"] and [x["elapsed_ms"] for x in lines if "elapsed_ms" in x] == [50, 100, 25, 50]
    facts, table = spark.createDataFrame([(3, 2)], "runs long, done long"), runs.select("analysis_id", "status").orderBy("analysis_id").limit(2)
    report = V.snapshot("Weekly", facts, runs=table).orderBy("section", "position").collect()
    assert [(r.section, json.loads(r.payload)) for r in report] == [("facts", {"title": "Weekly", "runs": 3, "done": 2}), ("runs", {"analysis_id": 1, "status": "COMPLETED"}), ("runs", {"analysis_id": 2, "status": "FAILED"})]
    signal = spark.createDataFrame([("r", ["x", "y"]), ("s", [])], "rule_id string, evidence array<string>")
    assert sorted(map(tuple, V.evidence_rows(signal).collect()), key=str) == [("r", "x"), ("r", "y"), ("s", None)]
    for _ in range(2):
        changes.append(facts, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_sweep_step_and_zero_fill(spark):
    at = datetime(2026, 1, 1, 12)
    rows = [(1, "RUNNING", datetime(2026, 1, 1, 11), datetime(2026, 1, 1)), (2, "RUNNING", datetime(2026, 1, 1, 11, 59), datetime(2026, 1, 1)), (3, "QUEUED", None, datetime(2025, 1, 2)), (4, "QUEUED", None, datetime(2026, 1, 3))]
    queue = spark.createDataFrame(rows, "id long, status string, started_at timestamp, created_at timestamp")
    got = {r.id: (r.status, r.started_at) for r in streams.sweep_step(queue, str(at), 600, 2).collect()}
    assert got == {1: ("RUNNING", at), 2: ("RUNNING", rows[1][2]), 3: ("RUNNING", at), 4: ("QUEUED", None)}
    counts = spark.createDataFrame([(datetime(2026, 1, 2), "a", 5)], "day timestamp, event_type string, n long")
    filled = {(str(r.day), r.event_type): r.n for r in streams.zero_filled(counts, "2026-01-01", "2026-01-02", ["a", "b"]).collect()}
    assert filled == {("2026-01-01", "a"): 0, ("2026-01-01", "b"): 0, ("2026-01-02", "a"): 5, ("2026-01-02", "b"): 0}


def test_flagged_lines_of_overlapping_intervals(spark, sf_dir):
    """Intervals that overlap, touch, repeat or are longer than what counts."""
    from quillon.operators import scoring

    rows = [(1, 1, "Q-OBF-001", 1, 2), (1, 1, "Q-OBF-001", 40, 40), (1, 1, "Q-CAP-001", 7, 7), (1, 2, "Q-CAP-001", 1, 10), (1, 2, "Q-CAP-002", 3, 5), (1, 2, "Q-CAP-003", 9, 12), (1, 2, "Q-CAP-003", 13, 13), (2, 1, "Q-CAP-001", 1, 10_000), (2, 1, "Q-CAP-002", 501, 501)]
    hits = spark.createDataFrame(rows, "analysis_id long, file_path long, rule_id string, line_start long, line_end long").selectExpr("*", "line_start AS line", "5D AS weight", "1D AS confidence", "1D AS modifier", "'HIGH' AS severity", "substring(rule_id, 3, 3) AS family")
    got = {(r.analysis_id, r.file_path): r.flagged_lines for r in scoring.file_risk(hits, rule(spark)).collect()}
    assert got == {(1, 1): 4, (1, 2): 13, (2, 1): 501}
    assert registry.QUERIES["timeline_union"](spark, sf_dir).select("at").first()[0] is not None
