import random

import pytest

from quillon.functions import script
from quillon.operators import detect, scripts

MEMBERS = frozenset(scripts.STARTING)


def found(text, *kinds):
    rows, readable, _ = script.facts(text, MEMBERS)
    assert readable, text
    return [r[2:] if r[0] != "sum" else r[3] for r in rows if r[0] in kinds]


def test_tokens():
    text = "#!/bin/x\nlet a = 'it\\'s' /* \" */ + `x${ {b: `y`} }z` / /[/]'/g.c // end\n"
    assert [(k, v) for k, _, _, v in script.tokens(text)] == [
        ("comment", "#!/bin/x"), ("name", "let"), ("name", "a"), ("punct", "="), ("string", "it's"), ("comment", '/* " */'), ("punct", "+"), ("template", "`"), ("chunk", "x"), ("punct", "${"), ("punct", "{"), ("name", "b"), ("punct", ":"),
        ("template", "`"), ("chunk", "y"), ("punct", "}"), ("punct", "}$"), ("chunk", "z"), ("punct", "/"), ("regex", "/[/]'/g"), ("punct", "."), ("name", "c"), ("comment", "// end"),
    ]
    assert script.unescaped(r"\x41B\u{43}é\n\'\q\101\0" + "\\\nx\\ud83d\\ude00") == "ABCé\n'qA\0x😀"


@pytest.mark.parametrize("text", ["a = 'x", 'a = "x\n"', "f(", "f]", "`a", "`${a`", "/* a", "{ ( }", "x = 'it\\"])
def test_unreadable(text):
    assert script.facts(text, MEMBERS)[1] is False


@pytest.mark.parametrize(
    "text, calls",
    [
        ("eval(x)", ["eval"]), ("new Function('a', b)", ["Function"]), ("await window.eval(x)", ["window.eval"]), ("global['eval'](x)", ["global.eval"]), ("a[b](x)", ["a[]"]), ("function eval(a) {}", []), ("class A { eval(x) { return 1 } }", []),
        ("x = { eval(a) {} }", []), ("if (a) (b)", []), ("a?.b(1)", []), ("f(g(h()))", ["h", "g", "f"]), ("f(1)(2)", ["f"]), ("require('a').b(c)", ["require"]), ("async (x) => y", []), ("'eval(x)'", []), ("// eval(x)", []), ("/eval(x)/", []), ("`eval(${f(x)})`", ["f"]),
    ],
)
def test_calls(text, calls):
    assert [r[0] for r in found(text, "call")] == calls


@pytest.mark.parametrize("argument, computed", [("'a'", 0), ("a", 1), ("'a' + b", 1), ("`a`", 1), ("'a', b", 0), ("", 0), ("atob('x')", 1), ("['a']", 1), ("...a", 1)])
def test_computed_modules(argument, computed):
    assert [n for name, n, _ in found(f"require({argument})", "call") if name == "require"] == [computed]


@pytest.mark.parametrize(
    "call, reads",
    [
        ("Object.keys(process.env)", True), ("Object.assign({}, process.env)", True), ("JSON.stringify({ ...process.env })", True), ("JSON.stringify({ a: 1, ...process.env })", True), ("Object.assign(...process.env)", True), ("Object.keys(process['env'])", True),
        ("JSON.stringify({ a: process.env })", False), ("Object.keys(process.env.HOME)", False), ("Object.keys([process.env])", False), ("Object.keys(f(process.env))", False), ("Object.keys(!process.env)", False), ("Object.keys(process.env || a)", False), ("Object.keys(a.process.env)", False),
    ],
)
def test_environment(call, reads):
    assert [bool(n & 2) for name, n, _ in found(call, "call") if name.startswith(("Object", "JSON"))] == [reads]


def test_tables():
    assert [r[1:] for r in found("a = ['x', \"00000000\", '\\x01',]; b = ['x', 1]; c = ['x' + 'y']; d = [,'x']; e = []; f = [['y']]; g['z']; [...'a']", "array")] == [(3, 2), (1, 0)]
    for value, want in (("", True), ("word", False), ("aGVsbG8gd29ybGQh", True), ("deadbeef", True), ("a b c d e f g h i j", False), ("é", True), ("12 34", True), ("tab\there", True)):
        assert script.encoded(value) is want


def depth(tree):
    return 1 if isinstance(tree, str) or tree[0] != "+" else 1 + max(depth(tree[1]), depth(tree[2]))


def written(tree, rng, right=False):
    """Text of a tree; brackets where they are needed."""
    if isinstance(tree, str):
        return tree
    sign, a, b = tree
    text = f"{written(a, rng)}{rng.choice(['', ' ', chr(10)])}{sign}{rng.choice([' ', ' /* + */ '])}{written(b, rng, True)}"
    return f"({text})" if right else text


def test_sums_against_trees():
    """Random expressions: left-associative sums, brackets on the right, products and calls as operands."""
    rng = random.Random(11)
    leaves = ["a", "'s'", "f(x)", "b.c", "`t`", "1", "[y]", "(u, v)", "-w", "(p ? q : r)"]

    def tree(n):
        if n <= 1:
            return rng.choice(leaves)
        k = rng.choice([1, n // 2, n - 1])
        return (rng.choice("++++-"), tree(n - k), tree(k))

    def deepest(t):
        return 1 if isinstance(t, str) else max(depth(t), deepest(t[1]), deepest(t[2]))

    for _ in range(300):
        t = tree(rng.randint(1, 14))
        rows = found(f"x = {written(t, rng)};", "sum")
        assert (rows or [1])[0] == deepest(t), written(t, rng)
    assert found("x = a * b + c * (d + e) + (f + g).h\ny = i + j", "sum") == [3]
    assert found("return a +\n b", "sum") == [2] and found("a, b", "sum") == [] and found("x = a == b + c", "sum") == [2]
    assert found("x = " + " + ".join(["'a'"] * 50_000), "sum") == [50_000]
    assert found("x = " + "(" * 5000 + "a + b" + ")" * 5000 + " + c", "sum") == [3]


def test_members_and_bindings():
    text = "import d, { e as f } from 'm'; import * as g from \"n\"; const { h, i: j } = require('o'), k = require('p').q; let l = await import('r'); d.exec(); x.y.spawn; z['fork'](); s[t].exec()"
    assert {(r[0], r[2]) for r in found(text, "bind")} == {("d", "m"), ("f", "m"), ("g", "n"), ("h", "o"), ("j", "o"), ("k", "p"), ("l", "r")}
    assert [(r[0], r[1]) for r in found(text, "import")] == [("m", 0), ("n", 0), ("o", 1), ("p", 1), ("r", 2)]
    assert [r[0] for r in found(text, "member")] == ["d.exec", "x.y.spawn", "z.fork", "s[].exec"]


TABLE = "t = [" + ", ".join(f"'{i:016x}'" for i in range(40)) + "]"


def test_signals(spark):
    files = [
        ("p", "a.js", "x = 1\n\neval(y)\nrequire(z)"), ("p", "b.ts", f"\n{TABLE}\n{TABLE}"), ("p", "c.js", TABLE.replace("39", "zz zz").replace("38", "ww ww")[: -len(", '0000000000000027']")] + "]"), ("p", "d.jsx", "s = 'a'" + " + 'b'" * 7),
        ("p", "e.js", "s = 'a'" + " + 'b'" * 6), ("p", "f.mjs", "o = {...process.env}"), ("p", "g.js", "eval(x"), ("p", "h.js", "('Object.keys(process.env)'"), ("p", "i.py", "eval(x)"), ("p", "j.js", None), ("p", "k.js", "// 8.8.8.8 fetch\nfetch('8.8.4.4'); fetch('8.8.8.8')"), ("p", "l.js", "fetch('http://192.0.2.1'"), ("p", "m.js", "fetch('100.64.0.1'"),
        ("q", "big.js", "cp.exec(a)" + " " * 99), ("q", "small.js", "import 'child_process'"), ("r", "big.js", "import 'node:child_process'" + " " * 99), ("r", "small.js", "cp.exec(a)"), ("s", "a.js", "rx.exec(a); a.fork(b)"), ("t", "b.js", "child_process.fork(a)"), ("t", "a.js", "x.spawnSync(a)    ;  "), ("u", "a.js", "require('child_process').exec(a); cp.exec(b)"),
        (None, "a.js", "eval(x)"), ("v", "x.js", ""),
    ]
    rows = scripts.signals(scripts.facts(spark.createDataFrame(files, "package string, path string, text string"))).collect()
    got = sorted(((r.package or "", r.path, r.rule_id, r.confidence, r.label, r.line) for r in rows))
    assert got == sorted([
        ("p", "a.js", "Q-OBF-003", 0.9, "eval", 3), ("p", "a.js", "Q-OBF-003", 0.8, "computed module", 4), ("p", "b.ts", "Q-OBF-004", 0.85, "encoded table", 2), ("p", "d.jsx", "Q-OBF-007", 0.7, "deep sum", 1), ("p", "f.mjs", "Q-CAP-004", 0.85, "spread", 1),
        ("p", "g.js", "Q-OBF-003", 0.5, "eval", 1), ("p", "h.js", "Q-CAP-004", 0.5, "environment", 1), ("p", "k.js", "Q-CAP-007", 0.75, "address", 2), ("p", "m.js", "Q-CAP-007", 0.5, "address", 1), ("q", "big.js", "Q-CAP-001", 0.6, "cp.exec", 1),
        ("t", "a.js", "Q-CAP-001", 0.6, "x.spawnSync", 1), ("", "a.js", "Q-OBF-003", 0.9, "eval", 1),
    ])


def test_tokens_table(spark):
    files = spark.createDataFrame([("p", "a.js", "a = 'b'\n// c"), ("p", "a.py", "a"), ("p", "b.js", None)], "package string, path string, text string")
    assert [tuple(r) for r in scripts.tokens(files).collect()] == [("p", "a.js", 1, 1, "name", "a"), ("p", "a.js", 3, 1, "punct", "="), ("p", "a.js", 5, 1, "string", "b"), ("p", "a.js", 9, 2, "comment", "// c")]


def test_entries(spark):
    """An install script runs a payload: mostly strings, or nothing but evaluation."""
    packages = spark.createDataFrame([("p", {"postinstall": "node a.js; node b; node c.js; node d.js; node e.js; node f.js"})], "package string, scripts map<string,string>")
    files = [("a.js", f"x = '{'word ' * 200}'"), ("b.js", "global.eval(y)"), ("c.js", "const y = require('y'); eval(y)"), ("d.js", "console.log(1)"), ("e.js", f"x = ('{'word ' * 200}'"), ("f.js", f"x = '{'word ' * 90}'"), ("g.js", "eval(z)")]
    files = spark.createDataFrame([("p", *f) for f in files], "package string, path string, text string")
    assert {(r.path, r.label) for r in detect.entry_signals(packages, files).collect()} == {("a.js", "postinstall: strings"), ("b.js", "postinstall: evaluation")}


def test_file_rules(spark):
    """Escaped quotes in literals, generated names of four digits, and hidden characters in prose."""
    noise = "".join(chr(33 + i * 37 % 90) for i in range(90)).replace('"', "").replace("'", "").replace("`", "").replace("\\", "")
    files = [("a.js", f'x = "{noise[:30]}\\"{noise[30:]}"'), ("b.js", "_0x1 " * 10), ("c.js", "a_0x1234 " * 10), ("d.md", "a ‮"), ("e.js", "// ‮"), ("f.js", "x = '" + "\\n" * 40_000 + "'")]
    rows = detect.file_signals(spark.createDataFrame([("p", *f) for f in files], "package string, path string, text string")).collect()
    assert {(r.path, r.rule_id, r.confidence) for r in rows if r.rule_id in ("Q-OBF-001", "Q-OBF-004", "Q-OBF-005")} == {("a.js", "Q-OBF-001", 0.85), ("c.js", "Q-OBF-004", 0.9), ("d.md", "Q-OBF-005", 0.8), ("e.js", "Q-OBF-005", 0.95)}
