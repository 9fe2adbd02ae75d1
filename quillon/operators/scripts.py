"""What script files do: tokens and facts as tables, and the rules that need them.

Each file is scanned once, in Arrow batches, where it lies; what follows works
on the few rows that a rule may ask for. Files have package, path and text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import script as S
from quillon.operators.text_rules import routable

#: Files that are scripts; the largest that is read; confidence in what an unreadable file seems to do.
SCRIPT, MOST_CHARS, UNREADABLE = r"(?i)\.(?:[cm]?[jt]s|[jt]sx)$", 2 * 1024 * 1024, 0.5
#: Calls that evaluate text; calls that list what an object has; names that start processes, alone and on receivers of these names.
EVALUATING = ["eval", "Function", "globalThis.eval", "window.eval", "global.eval", "vm.runInThisContext", "vm.runInNewContext", "vm.compileFunction", "process.binding"]
ENUMERATING = ["Object.keys", "Object.entries", "Object.values", "Object.assign", "JSON.stringify"]
STARTING, PROCESS_MODULE = ["execSync", "spawnSync", "spawn", "execFile", "execFileSync", "fork", "exec"], "child_process"
STARTS = r"\.(?:execSync|spawnSync|spawn|execFile|execFileSync)$"
FORKS, FORKS_ON = r"\.fork$", r"(?i)child_?process|^cp\.|^proc\."
RUNS_ON = r"(?:^|\.)(?i:child_process|childProcess|cp|proc|process)\.exec$"
#: Strings of a table, and how many of them are encoded; depth of sums; what a spread and an unreadable file show as they stand.
TABLE, ENCODED, DEEP = 40, 0.6, 8
SPREAD = r"\.\.\.\s*process\.env"
BYTES = [("Q-OBF-003", "eval", r"\beval\s*\(|new\s+Function\s*\("), ("Q-CAP-004", "environment", rf"Object\.(?:keys|entries|values)\s*\(\s*process\.env|{SPREAD}")]
#: Least length, and share of strings, of a file that is a payload; what an entry that imports nothing evaluates.
PAYLOAD_CHARS, PAYLOAD_SHARE, EVALUATES = 512, 0.7, r"eval|Function\s*\("
#: Addresses, what makes them calls, and how near.
IPV4, NETWORK, NEAR = re.compile(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", re.A), re.compile(r"https?:|connect|socket|fetch|request|axios|post|get\s*\(|curl|:\d{2,5}", re.A | re.I), 120

TOKENS = "package string, path string, at int, line int, kind string, text string"
FACTS = "package string, path string, size int, kind string, at int, line int, name string, n int, m int, module string, excerpt string"


def is_script(path: Column) -> Column:
    return path.rlike(SCRIPT)


def _table(batches: Iterator, schema: str, rows_of) -> Iterator:
    """Rows of each file, in batches of a few thousand."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]

    def batch(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(column, kinds[kind]) for column, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])

    held: list[tuple] = []
    for files in batches:
        for k in range(files.num_rows):
            for row in rows_of(*(files.column(c)[k].as_py() for c in range(3))):
                held.append(row)
                if len(held) == 4096:
                    yield batch(held)
                    held = []
    if held:
        yield batch(held)


def _texts(files: DataFrame) -> DataFrame:
    return files.where(F.col("text").isNotNull() & is_script(F.col("path"))).select(F.col("package").cast("string"), "path", "text")


def tokens(files: DataFrame) -> DataFrame:
    """(package, path, at, line, kind, text): the tokens of script files, comments included; strings without quotes and escapes, positions from 1.

    Kinds are comment, string, template, chunk, regex, name, number, punct and
    broken. Null texts have none.
    """

    def rows(package, path, text):
        line = S.Lines(text)
        for kind, start, _, value in S.tokens(text):
            yield package, path, start + 1, line(start), kind, value

    return _texts(files).mapInArrow(lambda batches: _table(batches, TOKENS, rows), TOKENS)


def around(text: str, at: int, width: int = 80) -> str:
    """What stands around a position, white space collapsed."""
    return re.sub(r"\s+", " ", text[max(0, at - width) : at + width]).strip(" ")


def addresses(text: str, comments: list[tuple[int, int]]) -> Iterator[tuple[int, str]]:
    """(position, address) outside comments, which are in order, with what may make a call of it near."""
    starts = [a for a, _ in comments]
    for m in IPV4.finditer(text):
        at = m.start()
        k = bisect_right(starts, at) - 1
        if (k < 0 or comments[k][1] <= at) and NETWORK.search(text[max(0, at - NEAR) : at + NEAR]):
            yield at, m[0]


def facts(files: DataFrame) -> DataFrame:
    """(package, path, size, kind, at, line, name, n, m, module, excerpt) of script files; positions from 1.

    Kinds are those of ``quillon.functions.script.Facts``; beside them, each file
    has a row ``file`` (n: 1 if it could be read; m: characters in literals), a row
    ``spread`` where it spreads the environment, and rows ``address`` (n as in
    ``file``) of addresses in what may be a call. A file that couldn't be read, or
    is too large, has no others but ``byte`` for what its text shows.
    """

    def rows(package, path, text):
        found, readable, chars = S.facts(text, frozenset(STARTING)) if len(text) <= MOST_CHARS else ([], False, 0)
        line, size = S.Lines(text), len(text.encode())
        if readable:
            if m := re.search(SPREAD, text):
                found.append(("spread", m.start(), None, None, None))
        else:
            found = [("byte", m.start(), rule, None, label) for rule, label, pattern in BYTES if (m := re.search(pattern, text))]
        comments = [(at, end) for kind, at, _, end, _ in found if kind == "comment"]
        found += [("address", at, address, int(readable), None) for at, address in addresses(text, comments)]
        for kind, at, name, n, m in found:
            shown = around(text, at) if kind not in ("literal", "comment", "bind", "import") else None
            yield package, path, size, kind, at + 1, line(at), name, n, m if isinstance(m, int) else None, m if isinstance(m, str) else None, shown
        yield package, path, size, "file", 1, 1, None, int(readable), chars, None, None

    return _texts(files).mapInArrow(lambda batches: _table(batches, FACTS, rows), FACTS)


def literals(found: DataFrame) -> DataFrame:
    """(package, path, at, line, value) of string literals and pieces of templates."""
    return found.where("kind = 'literal'").select("package", "path", "at", "line", F.col("name").alias("value"))


def starts_process(name: Column) -> Column:
    """Whether a dotted name starts a process: names that only processes have, or others on a receiver that is called like the module."""
    return name.rlike(STARTS) | (name.rlike(FORKS) & name.rlike(FORKS_ON)) | name.rlike(RUNS_ON)


def bound_calls(found: DataFrame) -> DataFrame:
    """(package, path, line, callee, module): calls whose receiver, or that themselves, are names bound to a module in the same file.

    Bindings and calls meet by file and name in one shuffle; a name that is bound
    to several modules has a row for each.
    """
    root = F.substring_index("name", ".", 1)
    rows = found.where("kind IN ('bind', 'call')").select("package", "path", "kind", "line", "name", "module", root.alias("root"))
    modules = F.collect_set("module").over(Window.partitionBy("package", "path", "root"))
    return rows.withColumn("modules", modules).where("kind = 'call'").select("package", "path", "line", F.col("name").alias("callee"), F.explode("modules").alias("module"))


def signals(found: DataFrame) -> DataFrame:
    """(package, path, rule_id, confidence, label, line, excerpt) of the rules that need facts, all from one scan.

    Q-OBF-003: calls that evaluate text, and modules named by anything but a
    literal. Q-OBF-004: the first table of encoded strings of a file. Q-OBF-007:
    the deepest sum of a file. Q-CAP-004: calls that list the environment, and
    its spread. Q-CAP-007: the first routable address of a file in what may be a
    call. Q-CAP-001: one member that starts a process, in the largest file that
    has one, unless that file or a larger one imports the module.

    One sum by key serves all: rows that decide on Q-CAP-001 meet by package, all
    others by file, so a package with many files is summed up before it travels.
    """
    name, kind = F.col("name"), F.col("kind")

    def hit(test: Column, rule, confidence: float, label) -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.when(test, F.struct(as_column(rule).alias("rule_id"), F.lit(confidence).alias("confidence"), as_column(label).alias("label")))

    imported, member = (kind == "import") & (F.regexp_replace(name, "^node:", "") == PROCESS_MODULE), (kind == "member") & starts_process(name)
    address = (kind == "address") & routable(name)
    hits = F.array_compact(
        F.array(
            hit((kind == "call") & name.isin(EVALUATING), "Q-OBF-003", 0.9, name),
            hit((kind == "call") & (name == "require") & (F.col("n").bitwiseAND(1) == 1), "Q-OBF-003", 0.8, "computed module"),
            hit((kind == "call") & name.isin(ENUMERATING) & (F.col("n").bitwiseAND(2) == 2), "Q-CAP-004", 0.8, name),
            hit(kind == "spread", "Q-CAP-004", 0.85, "spread"),
            hit((kind == "array") & (F.col("n") >= TABLE) & (F.col("m") / F.col("n") >= ENCODED), "Q-OBF-004", 0.85, "encoded table"),
            hit((kind == "sum") & (F.col("n") >= DEEP), "Q-OBF-007", 0.7, "deep sum"),
            hit(kind == "byte", name, UNREADABLE, F.col("module")),
            hit(address & (F.col("n") == 1), "Q-CAP-007", 0.75, "address"),
            hit(address & (F.col("n") == 0), "Q-CAP-007", UNREADABLE, "address"),
            hit(member | imported, "Q-CAP-001", 0.6, name),
        )
    )
    rows = found.where(kind.isin("call", "spread", "array", "sum", "byte", "address", "member", "import")).select("*", F.explode(hits).alias("h")).select("package", "path", "size", "kind", "at", "line", "excerpt", "h.*")
    by_package, once = kind.isin("member", "import"), kind.isin("array", "address")
    order = F.struct(-F.col("size"), F.col("path"))  # files are looked at from the largest on
    first = F.struct("at", "line", "label", "excerpt")
    sums = rows.groupBy("package", F.when(~by_package, F.col("path")).alias("file"), "rule_id", "confidence", F.when(~by_package & ~once, F.col("at")).alias("place")).agg(
        F.min(F.when(~by_package, first)).alias("own"),
        F.min(F.when(kind == "import", order)).alias("imported"),
        F.min(F.when(kind == "member", F.struct(order.alias("order"), F.col("path"), first.alias("own")))).alias("member"),
    )
    f = F.coalesce("own", "member.own")
    kept = sums.where(F.col("own").isNotNull() | (F.col("member").isNotNull() & (F.col("imported").isNull() | (F.col("member.order") < F.col("imported")))))
    return kept.select("package", F.coalesce("file", "member.path").alias("path"), "rule_id", "confidence", f["label"].alias("label"), f["line"].alias("line"), f["excerpt"].alias("excerpt"))


def reading(text: Column) -> Column:
    """Whether a text can be read, characters in its literals, and modules that it imports."""

    @F.pandas_udf("readable boolean, chars int, imports int")
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found, readable, chars = S.facts(text, frozenset()) if text is not None and len(text) <= MOST_CHARS else ([], False, 0)
            rows.append((readable, chars, sum(r[0] == "import" for r in found)))
        return pd.DataFrame(rows, columns=["readable", "chars", "imports"])

    return read(text)


def payload_reason(text: Column, read: Column) -> Column:
    """Why an entry that can be read is a payload rather than code, or null; ``read`` is what ``reading`` gives."""
    strings = (F.length(text) > PAYLOAD_CHARS) & (read["chars"] / F.length(text) > PAYLOAD_SHARE)
    evaluates = (read["imports"] == 0) & text.rlike(EVALUATES)
    return F.when(read["readable"] & strings, "strings").when(read["readable"] & evaluates, "evaluation")
