"""Scans of file texts: patterns are data, and one pass over the text serves all rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.core import half_up

#: What each context is known by in a package's name, description and keywords, in the order in which contexts decide, and dependents that make a framework.
CONTEXT_WORDS = [
    ("BUILD_TOOL", [r"\bbuild\b", r"\bbundler?\b", r"\bcompiler?\b", r"\btranspiler?\b", r"\bcli\b", r"\btask[- ]?runner\b", r"\btest[- ]?runner\b", r"\blinter?\b", r"\bwebpack\b", r"\brollup\b", r"\besbuild\b", r"\bvite\b", r"\bbabel\b", r"\bscaffold", r"\bgenerator\b", r"\bcodegen\b"]),
    ("SYSTEM", [r"\bshell\b", r"\bexec\b", r"\bspawn\b", r"\bprocess\b", r"\bfilesystem\b", r"\bdaemon\b", r"\bnative\b", r"\bbinding", r"\bnode-gyp\b", r"\bprebuild", r"\bffi\b", r"\bsystem\b"]),
    ("NETWORK", [r"\bhttp\b", r"\bhttps\b", r"\bclient\b", r"\brequest\b", r"\bfetch\b", r"\bsocket\b", r"\bwebsocket\b", r"\bapi\b", r"\brpc\b", r"\bgrpc\b", r"\bserver\b", r"\bproxy\b", r"\bdns\b"]),
    ("FRAMEWORK", [r"\bframework\b", r"\breact\b", r"\bvue\b", r"\bangular\b", r"\bsvelte\b", r"\bnext\.?js\b", r"\bnuxt\b", r"\bexpress\b", r"\bfastify\b", r"\bkoa\b", r"\bssr\b"]),
]
FRAMEWORK_DEPENDENTS = 500
#: Characters of a class that may stand for themselves.
CLASS = 32
RUN = r"(?:[A-Za-z0-9+/]{40,}={0,2}|[0-9a-f]{40,})"
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def entropy(text: Column) -> Column:
    """Bits a character, over code points; 0 for empty text."""
    counted = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    p = lambda n: n / F.length(text)
    return F.when(F.length(text) > 0, F.aggregate(F.filter(counted, lambda n: n > 0), F.lit(0.0), lambda s, n: s - p(n) * F.log2(p(n)))).otherwise(0.0)


def character_entropy(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, entropy) over many long texts: characters are exploded by document and counted, with partial sums on each side."""
    chars = docs.select(key, F.explode(F.split(F.col(text), "")).alias("c")).groupBy(key, "c").agg(F.count("*").alias("n"))
    sums = chars.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(key, half_up(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


def average_line(text: Column) -> Column:
    return F.length(text) / F.size(F.split(text, "\n"))


def required(pattern: str) -> list[str] | None:
    """Strings, in lower case, of which each match contains one; null where the expression asks for none.

    Of what an expression has one after the other, the part whose shortest string
    is longest serves; a choice needs the strings of all its branches.
    """
    from re import _parser

    return _required(_parser.parse(pattern))


def _required(items) -> list[str] | None:
    found: list[list[str]] = []
    run = ""
    for op, value in [*items, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if run:
            found.append([run])
            run = ""
        inner = None
        if name == "BRANCH":
            branches = [_required(b) for b in value[1]]
            inner = None if None in branches else sorted({x for b in branches for x in b})
        elif name == "SUBPATTERN":
            inner = _required(value[-1])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner = _required(value[2])
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in value):
            chars = [c for o, v in value for c in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))]
            inner = [chr(c) for c in chars] if len(chars) <= CLASS else None
        if inner:
            found.append(inner)
    best = max(found, key=lambda x: min(map(len, x)), default=None)
    return None if best is None else sorted({x.lower() for x in best})


def matches(docs: DataFrame, key: str, text: str, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """(key, rule_id, label, hits) of the patterns (rule, label, expression) that occur.

    One Aho-Corasick automaton over the strings that the expressions ask for reads
    each text once and tells which few expressions are worth running on it; its
    size is that of the patterns. Null texts have no rows; repeated rows are each
    scanned.
    """
    owners: dict[str, list[int]] = {}
    always = []
    for k, (_, _, pattern) in enumerate(patterns):
        strings = required(pattern)
        always += [k] if strings is None else []
        for x in strings or []:
            owners.setdefault(x, []).append(k)
    held = docs.sparkSession.sparkContext.broadcast((owners, always))

    @F.pandas_udf("array<int>")
    def possible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        strings, rest = held.value
        automaton = ahocorasick.Automaton()
        for x, own in strings.items():
            automaton.add_word(x, tuple(own))
        automaton.make_automaton()
        for part in batches:
            yield part.map(lambda t: sorted({k for _, own in set(automaton.iter(t.lower())) for k in own} | set(rest)) if t is not None else [])

    one = lambda k, r, label, p: F.when(F.array_contains("some", k), F.struct(F.lit(r).alias("rule_id"), F.lit(label).alias("label"), F.regexp_count(F.col(text), F.lit(p)).cast("long").alias("hits")))
    found = F.filter(F.array(*(one(k, *p) for k, p in enumerate(patterns))), lambda x: x["hits"] > 0)
    some = docs.select(key, text, possible(text).alias("some")).where(F.size("some") > 0)
    return some.select(key, F.explode(found).alias("m")).select(key, "m.*")


def octet(address: Column, i: int) -> Column:
    return F.element_at(F.split(address, r"\."), i).cast("int")


def routable(address: Column) -> Column:
    """Neither private, reserved, local, nor malformed."""
    a, b, c, d = (octet(address, i) for i in (1, 2, 3, 4))
    valid = (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)
    reserved = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & b.isin(0, 168)) | ((a == 169) & (b == 254)) | ((a == 198) & b.isin(18, 19, 51)) | ((a == 203) & (b == 0))
    return valid & ~reserved


def context(text: Column, dependents: Column | None = None) -> Column:
    """The first context that a name, description or keyword tells of; a package that many depend on is a framework."""
    out = F.when(dependents >= FRAMEWORK_DEPENDENTS, "FRAMEWORK") if dependents is not None else None
    for name, patterns in CONTEXT_WORDS:
        test = F.lower(text).rlike("|".join(patterns))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("UTILITY")
