import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from quillon.operators import diff, exports, limits
from quillon.sources import archives, lockfiles
from quillon.streaming import limits as streams


def tgz(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in files:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type, info.linkname = tarfile.SYMTYPE, "/etc/passwd"
                tar.addfile(info)
            else:
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_archives(spark, tmp_path):
    good = tgz([("package/index.js", b"x=1\n"), ("package/bin.node", b"\0\1"), ("../evil", b"x"), ("/abs", b"x"), ("package/link", None), ("package/big", b"y" * 101)])
    (tmp_path / "a.tgz").write_bytes(good)
    (tmp_path / "b.tgz").write_bytes(good[:40])
    rows = archives.read(spark, str(tmp_path), largest=100).collect()
    a = {r.path: r for r in rows if r.archive == "a.tgz"}
    assert (a["index.js"].size, a["index.js"].is_binary, a["bin.node"].is_binary) == (4, False, True)
    assert {p: r.rejected for p, r in a.items() if r.rejected} == {"../evil": "path leaves the archive", "/abs": "absolute path", "package/link": "not a file", "package/big": "file too large"}
    assert [r.rejected.split(":")[0] for r in rows if r.archive == "b.tgz"] == ["damaged"]


LOCKS = {
    "v3": json.dumps({"lockfileVersion": 3, "packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"version": "1.0.0", "dependencies": {"b": "2"}}, "node_modules/a/node_modules/b": {"version": "2.0.0"}}}),
    "v1": json.dumps({"lockfileVersion": 1, "dependencies": {"a": {"version": "1.0.0", "requires": {"b": "2"}, "dependencies": {"b": {"version": "2.0.0"}}}}}),
    "yarn": '# yarn lockfile v1\n\n"@s/a@^1.0.0", "@s/a@~1":\n  version "1.0.0"\n  dependencies:\n    b "^2"\n\nb@^2:\n  version "2.0.0"\n',
    "bad": "{not json",
    "none": None,
}


def test_lockfiles(spark):
    rows = lockfiles.read(spark.createDataFrame(list(LOCKS.items()), "file string, text string")).collect()
    of = lambda f, k: sorted((r.name or "", r.version or r.child) for r in rows if r.file == f and r.kind == k)
    for f, a in (("v3", "a"), ("v1", "a"), ("yarn", "@s/a")):
        assert of(f, "entry") == sorted([(a, "1.0.0"), ("b", "2.0.0")]) and of(f, "edge") == [(a, "b")]
    assert of("v3", "root") == of("v1", "root") == [("", "a")]
    assert [(r.file, r.format) for r in rows if r.kind == "none"] == [("bad", "unknown"), ("none", "unknown")]


def test_diff(spark):
    pairs = [(1, "a\nb\nc\nd", "a\nx\nc\nd"), (2, None, "n"), (3, "s\n" * 20 + "o", "s\n" * 20 + "n"), (4, "", "")]
    rows = diff.compare(spark.createDataFrame(pairs, "pair long, old string, new string"))
    kinds = {p: [r.kind for r in sorted(rows.where(f"pair = {p}").collect(), key=lambda r: r.position)] for p in (1, 2, 4)}
    assert kinds == {1: ["same", "delete", "insert", "same", "same"], 2: ["insert"], 4: []}
    shown = sorted(diff.collapse(rows).where("pair = 3").collect(), key=lambda r: r.position)
    assert [(r.kind, r.text) for r in shown] == [("gap", "17"), ("same", "s"), ("same", "s"), ("same", "s"), ("delete", "o"), ("insert", "n")]


def test_diff_keeps_longest_common_lines():
    import difflib
    import random

    rnd = random.Random(2)
    for _ in range(200):
        a, b = (["abc"[rnd.randint(0, 2)] for _ in range(rnd.randint(0, 9))] for _ in range(2))
        rows, large = diff.lines("\n".join(a), "\n".join(b))
        assert not large
        assert [t for k, _, _, t in rows if k != "insert"] == (a if a else []) and [t for k, _, _, t in rows if k != "delete"] == (b if b else [])
        least = sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks())
        assert sum(k == "same" for k, *_ in rows) >= least


def test_positions_when_large(monkeypatch):
    monkeypatch.setattr(diff, "LARGE", 2)
    rows, large = diff.lines("a\nb\nc", "x\ny\nz\nw")
    assert large and [k for k, *_ in rows] == ["delete", "insert"] * 3 + ["insert"]


@pytest.fixture(scope="module")
def event_files(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat_ws("-", "user_id", "event_type").alias("bucket"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.repartitionByRange(4, "ts").write.mode("overwrite").parquet(str(folder / "in"))
    return events, str(folder)


@pytest.fixture
def state_store(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run_limiter(spark, folder, schema, name, late, files=1):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    made = streams.limiter(stream, 86_400, 2, late).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    made.awaitTermination(240)
    return {r.event_id: (r.used, r.allowed) for r in spark.table(name).collect()}, made.lastProgress


def test_stream_limiter_is_the_batch_result(spark, event_files, state_store):
    events, folder = event_files
    got, _ = run_limiter(spark, f"{folder}/in", events.schema, "decisions", "0 seconds", 100)
    want = {r.event_id: (r.used, r.used <= 2) for r in limits.sliding(events, ["bucket"], "ts", "event_id", 86_400, 2).collect()}
    del want[events.selectExpr("max_by(event_id, ts)").first()[0]]  # the watermark has not passed the newest event
    assert got == want


def test_limiter_with_late_events_and_ties(spark, tmp_path, state_store):
    """Batches in mixed order within the delay decide like the whole log in order; a bucket that has been idle leaves no state."""
    rnd = random.Random(6)
    hour = 3600
    rows = [(rnd.choice("ab"), i, 10**9 + (i // 2) * 7 * hour + rnd.choice([0, 0, 3 * hour])) for i in range(120)] + [("c", 1000, 10**9 + hour), ("c", 1001, 10**9 + hour), (None, 1002, 10**9 + hour), ("c", 1003, None)]
    last = max(r[2] for r in rows if r[2]) + 10 * 24 * hour
    rows.append(("end", 2000, last))
    frame = spark.createDataFrame(rows, "bucket string, event_id long, s long").selectExpr("bucket", "event_id", "timestamp_seconds(s) AS ts")
    order = sorted(rows, key=lambda r: ((r[2] or 0) // (24 * hour) * 24 + rnd.choice([0, 23]), r[1]))
    for k in range(6):
        ids = [r[1] for r in order[k * len(order) // 6 : (k + 1) * len(order) // 6]]
        frame.where(F.col("event_id").isin(ids)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, progress = run_limiter(spark, str(tmp_path / "in"), frame.schema, "late_decisions", "9 days")
    known = frame.where("bucket IS NOT NULL AND ts IS NOT NULL AND bucket <> 'end'")
    want = {r.event_id: (r.used, r.used <= 2) for r in limits.sliding(known, ["bucket"], "ts", "event_id", 86_400, 2).collect()}
    assert {k: v for k, v in got.items() if k != 2000} == want and any(v[0] > 2 for v in want.values())


def test_stream_throughput_is_the_batch_result(spark, event_files):
    events, folder = event_files
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    made = streams.throughput(stream).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    made.awaitTermination(120)
    got = {(r.day, r.event_type): r.n for r in spark.table("daily").collect()}
    want = {(r.day, r.event_type): r["count"] for r in events.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").count().collect()}
    assert got == want


def test_sweep(spark, event_files):
    events, folder = event_files
    seen = []
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    streams.sweep(stream, lambda batch, k: seen.append(batch.count()), f"{folder}/checkpoint").awaitTermination(120)
    assert sum(seen) == events.count() and len(seen) == 4


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 'a"b'), (None, "x")], "a string, b string")
    exports.write_csv(df.coalesce(1), str(tmp_path / "csv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ['"\'=1+1","a""b"', '"","x"']
    items = spark.createDataFrame([(1, "@s/a b", "1.0"), (1, "b", "2"), (2, "c", "3")], "root long, name string, version string")
    docs = {r.root: json.loads(r.document) for r in exports.sbom(items, "root").collect()}
    assert [c["purl"] for c in docs[1]["components"]] == ["pkg:npm/%40s/a%20b@1.0", "pkg:npm/b@2"] and docs[2]["bomFormat"] == "CycloneDX"
    assert len({d["serialNumber"] for d in docs.values()}) == 2
