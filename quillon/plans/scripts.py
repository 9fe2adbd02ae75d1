"""Scripts made of the texts: each document is a script file of the package that is its source.

What a script does follows from its id and words, so that SQL can say without a
scan which facts must come of it.
"""

from pyspark.sql import functions as F

from quillon.operators import scripts as S
from quillon.plans.registry import query

#: Words of ASCII letters, without those of the language; the same in SQL.
_WORDS = "list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda w: length(w) > 9)"
_LINES = "string_split(coalesce(text, ''), chr(10))"


def words():
    return F.filter(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), 0), lambda w: F.length(w) > 9)


def files(documents, body):
    return documents.where("doc_id IS NOT NULL").select(F.col("source").alias("package"), F.concat(F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), body.alias("text"))


def doc_id(path="path"):
    return F.substring_index(path, ".", 1).cast("long").alias("doc_id")


def quoted(x, quote: str):
    """A string literal: back-slashes and quotes get a back-slash, and lines are joined by one."""
    return F.concat(F.lit(quote), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit(quote), F.lit("\\" + quote)), F.lit(quote))


@query(f"""SELECT doc_id, CAST(len(l) AS BIGINT) AS literals, CAST(list_sum(list_transform(l, lambda x: length(x))) AS BIGINT) AS chars, CAST(len(list_filter(l, lambda x: length(x) > 0)) AS BIGINT) AS filled, sha256(array_to_string(l, chr(10))) AS hash
  FROM (SELECT doc_id, {_LINES} AS l FROM documents WHERE doc_id IS NOT NULL)""")
def script_literals(documents):
    """Each line of a text as a literal, double-quoted, single-quoted or a template in turn, between comments with quotes in them: the scan gives the lines back."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    template = lambda x: F.concat(F.lit("`"), F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("`"), F.lit("\\`")), F.lit("${"), F.lit("\\${")), F.lit("`"))
    statement = lambda x, i: F.concat(F.lit("// it's \"a\nx /* ` */ = "), F.when(i % 3 == 0, quoted(x, '"')).when(i % 3 == 1, quoted(x, "'")).otherwise(template(x)), F.lit(" / 2 // y/\n"))
    found = S.literals(S.facts(files(documents, F.array_join(F.transform(lines, statement), ""))))
    values = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])  # as long as the text
    rows = found.groupBy("path").agg(F.count("*").alias("literals"), F.sum(F.length("value")).alias("chars"), F.count_if(F.length("value") > 0).alias("filled"), F.sha2(F.array_join(values, "\n").cast("binary"), 256).alias("hash"))
    return rows.select(doc_id(), "literals", "chars", "filled", "hash")


@query(f"""SELECT doc_id, rule_id, CAST(confidence AS DOUBLE) AS confidence, line FROM (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
  (VALUES ('Q-OBF-003', 0.9, 1), ('Q-OBF-003', 0.8, 2), ('Q-OBF-004', 0.85, 3), ('Q-OBF-007', 0.7, 4), ('Q-CAP-004', 0.8, 5), ('Q-CAP-007', 0.75, 7)) r(rule_id, confidence, line)
  WHERE CASE line WHEN 1 THEN doc_id % 3 = 0 WHEN 2 THEN doc_id % 4 <> 0 WHEN 3 THEN len(w) >= 40 AND doc_id % 5 <> 0 WHEN 4 THEN len(w) >= 7 WHEN 5 THEN doc_id % 2 = 0 ELSE doc_id % 6 = 1 END""")
def script_rules(documents):
    """Rules that need tokens: calls, module names, tables of strings, sums, the environment, and addresses outside comments."""
    k, w = F.col("doc_id"), words()
    body = F.concat_ws(
        "\n",
        F.when(k % 3 == 0, "if (a) { new Function('b') }").when(k % 3 == 1, "function eval(a) { return /eval(1)/ }").otherwise("// eval(1)"),
        F.when(k % 4 == 0, "const a = require('b')").when(k % 4 == 1, "require(a)").when(k % 4 == 2, "require(`b`)").otherwise("require('b' + c)"),
        F.concat(F.lit("t = ["), F.array_join(F.transform(w, lambda x: F.when(k % 5 == 0, F.concat(F.lit("'"), F.substring(x, 1, 9), F.lit(" is it'"))).otherwise(F.concat(F.lit("'"), F.lit("\\x01"), x, F.lit("'")))), ", "), F.lit("]")),
        F.concat(F.lit("s = (q * 2) + "), F.when(F.size(w) > 0, F.array_join(F.transform(w, lambda x: F.concat(F.lit("\""), x, F.lit("\""))), " + ")).otherwise("1"), F.lit(" - 1")),
        F.when(k % 2 == 0, "Object.keys(process.env)").otherwise("Object.keys(process.env.HOME, [process.env])"),
        F.lit("/* fetch('http://8.8.4.4') */"),
        F.when(k % 6 == 1, "fetch('http://9.9.9.9:80')").when(k % 6 == 2, "fetch('http://10.9.9.9:80')").otherwise("v = 1"),
    )
    return S.signals(S.facts(files(documents, body))).select(doc_id(), "rule_id", F.col("confidence"), "line")


_FILES = f"""SELECT doc_id, source, doc_id % 7 AS k, strlen(t) AS size, concat(doc_id, '.js') AS path FROM (SELECT *, concat(CASE doc_id % 7 WHEN 0 THEN 'const cp = require("node:child_process")' WHEN 1 THEN 'proc.exec("ls")' WHEN 2 THEN 'const rx = /a/; rx.exec(b)'
  WHEN 3 THEN 'a.b.spawnSync(c)' WHEN 4 THEN 'import {{ fork as split }} from "child_process"' ELSE '1' END, chr(10), '// ', replace(coalesce(text, ''), chr(10), ' ')) AS t FROM documents WHERE doc_id IS NOT NULL)"""


def process_files(documents):
    k = F.col("doc_id") % 7
    first = F.when(k == 0, 'const cp = require("node:child_process")').when(k == 1, 'proc.exec("ls")').when(k == 2, "const rx = /a/; rx.exec(b)").when(k == 3, "a.b.spawnSync(c)").when(k == 4, 'import { fork as split } from "child_process"').otherwise("1")
    return files(documents, F.concat(first, F.lit("\n// "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" "))))


@query(f"""WITH f AS ({_FILES}), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, path) AS n FROM f),
  m AS (SELECT source, min(CASE WHEN k IN (0, 4) THEN n END) AS imported, min(CASE WHEN k IN (1, 3) THEN n END) AS member FROM o GROUP BY 1)
  SELECT o.source AS package, o.path, CASE k WHEN 1 THEN 'proc.exec' ELSE 'a.b.spawnSync' END AS member, o.size FROM o JOIN m ON o.source = m.source AND o.n = m.member WHERE imported IS NULL OR member < imported""")
def script_process_members(documents):
    """Processes started without an import: one finding a package, from its largest files on."""
    found = S.facts(process_files(documents))
    sizes = process_files(documents).select("package", "path", F.octet_length("text").alias("size"))
    return S.signals(found).where("rule_id = 'Q-CAP-001'").join(sizes, ["package", "path"]).select("package", "path", F.col("label").alias("member"), "size")


@query("""SELECT doc_id, callee, module, line FROM (SELECT doc_id, doc_id % 5 AS k FROM documents WHERE doc_id IS NOT NULL), (VALUES
  (0, 'cp.exec', 'child_process', 2), (1, 'run', 'child_process', 3), (1, 'net.connect', 'net', 4), (2, 'vm.runInNewContext', 'vm', 2), (3, 'late.get', 'https', 3)) r(r, callee, module, line) WHERE k = r""")
def script_bound_calls(documents):
    """Calls by names that are bound to modules in the same file."""
    k = F.col("doc_id") % 5
    body = (
        F.when(k == 0, "const cp = require('child_process')\ncp.exec('ls')\nother.exec('ls')")
        .when(k == 1, "const { exec: run } = require('child_process')\nimport * as net from 'net'\nrun('ls')\nnet.connect(1)\nexec('ls')")
        .when(k == 2, "import vm, { Script } from 'vm'\nvm.runInNewContext(a)\nvm2.run(b)")
        .when(k == 3, "async function f() {\n  const late = await import('https')\n  late.get(u)\n}")
        .otherwise("const text = 'require(\"net\")'\ntext.slice(1)")
    )
    return S.bound_calls(S.facts(files(documents, body))).select(doc_id(), "callee", "module", "line")
