from quillon.operators import detect
from quillon.sources import views


def test_entry_address_and_native_rules(spark):
    packages = spark.createDataFrame([("p", {"postinstall": "node ./run && node plain.js"}, {}, []), ("q", {}, {"bindings": "1"}, []), ("r", {}, {}, []), ("s", {}, {}, ["Native"])], "package string, scripts map<string,string>, dependencies map<string,string>, keywords array<string>")
    files = [
        ("p", "run.js", "let _0xab12 = 1"), ("p", "plain.js", "let a = 1"), ("p", "other.js", "let _0xab12 = 1"), ("p", "b.so", None), ("q", "b.node", None), ("r", "binding.gyp", "{}"), ("r", "b.dll", None), ("s", "b.wasm", None),
        ("q", "call.js", "// 8.8.4.4 fetch\nx = 'http://a//b'\nfetch('http://8.8.8.8:80')"), ("q", "comment.js", "/* fetch 8.8.8.8 */ // http://9.9.9.9"), ("q", "local.js", "fetch('http://192.168.1.1:80')"), ("q", "version.js", "v = '8.8.8.8'"),
    ]
    files = spark.createDataFrame(files, "package string, path string, text string")
    signals = detect.install_signals(packages, files).unionByName(detect.file_signals(files)).unionByName(detect.native_signals(packages, files))
    found = {(r.package, r.path, r.rule_id): (r.confidence, r.line) for r in signals.collect()}
    assert {k: v for k, v in found.items() if k[2] in ("Q-INS-007", "Q-CAP-007", "Q-CAP-009")} == {("p", "run.js", "Q-INS-007"): (0.8, 1), ("q", "call.js", "Q-CAP-007"): (0.75, 3), ("p", "b.so", "Q-CAP-009"): (0.9, None)}
    fired = {(r.package, r.rule_id) for r in detect.dense_signals(packages, signals, views.rule(spark)).collect() if r.fired}
    assert {("p", "Q-INS-007"), ("q", "Q-CAP-007"), ("p", "Q-CAP-009")} <= fired
