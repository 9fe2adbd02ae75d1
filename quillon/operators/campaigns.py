"""Clusters of packages that share an indicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hosts that say nothing.
INFRASTRUCTURE = [
    "registry.npmjs.org", "registry.yarnpkg.com", "pypi.org", "files.pythonhosted.org", "github.com", "raw.githubusercontent.com", "objects.githubusercontent.com", "codeload.github.com", "gitlab.com",
    "bitbucket.org", "localhost", "example.com", "www.example.com", "schemas.npmjs.com", "json-schema.org", "www.w3.org",
]
#: The longest indicator, and characters of its name.
LONGEST, NAME_LENGTH = 255, 64


def host(url: Column) -> Column:
    """Lower case, without credentials and port; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


#: Shapes of wallet addresses (hexadecimal ones are folded), rules whose evidence has a host or address, a file's hash, or a maintainer of a takeover.
WALLETS = [r"\b0x[a-fA-F0-9]{40}\b", r"\b(?:bc1[a-z0-9]{25,62})\b", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", r"\bT[a-km-zA-HJ-NP-Z1-9]{33}\b"]
ENDPOINT_RULES, BINARY_RULES, MAINTAINER_RULES = ["Q-CAP-007", "Q-CAP-008"], ["Q-CAP-009"], ["Q-MNT-002", "Q-MNT-003"]
URL_IN_TEXT = r"""(?i)\bhttps?://[^\s'"`)\\<>]+"""
GATE = ["KNOWN_MALICIOUS", "LIKELY_MALICIOUS", "SUSPICIOUS"]


def indicators(hits: DataFrame) -> DataFrame:
    """(member, type, value, confidence, seen) from hits (member, rule_id, excerpt, address, sha256, maintainer, confidence, verdict, seen) of packages that are at least suspicious.

    Endpoints are addresses and hosts that aren't infrastructure; wallets occur
    in any excerpt; hashes are those of undeclared binaries; maintainers count
    only in a takeover.
    """
    rule, text = F.col("rule_id"), F.coalesce("excerpt", F.lit(""))
    kind = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("type"), v.alias("value")))
    none = F.array().cast("array<string>")
    own = lambda test, value: F.when(test & value.isNotNull() & (value != ""), F.array(value)).otherwise(none)
    hosts = F.when(rule.isin(ENDPOINT_RULES), F.filter(F.transform(F.regexp_extract_all(text, F.lit(URL_IN_TEXT), 0), host), lambda h: h.isNotNull())).otherwise(none)
    wallets = F.concat(*(F.regexp_extract_all(text, F.lit(p), 0) for p in WALLETS))
    who = F.lower("maintainer")
    found = F.concat(
        kind("EXFIL_ENDPOINT", own(rule.isin(ENDPOINT_RULES), F.col("address"))), kind("EXFIL_ENDPOINT", hosts),
        kind("WALLET", F.transform(wallets, lambda w: F.when(F.startswith(w, F.lit("0x")), F.lower(w)).otherwise(w))),
        kind("CODE_HASH", own(rule.isin(BINARY_RULES) & F.col("sha256").rlike("(?i)^[a-f0-9]{64}$"), F.lower("sha256"))),
        kind("MAINTAINER", own(rule.isin(MAINTAINER_RULES) & (who != "unknown"), who)),
    )
    rows = hits.where(F.col("verdict").isin(GATE)).select("member", "seen", "confidence", F.explode(found).alias("i")).select("member", "seen", "confidence", "i.type", "i.value")
    return rows.where(~F.col("value").isin(INFRASTRUCTURE)).groupBy("member", "type", "value").agg(F.max("confidence").alias("confidence"), F.min("seen").alias("seen"))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", *parts).cast("binary"), 256)


def clusters(indicators: DataFrame, least: int = 2) -> DataFrame:
    """Indicators (type, value, member, seen) that at least so many members share, with first and last sighting.

    A late sighting widens the window. Sums are partial, so a common indicator isn't gathered in one task.
    """
    rows = indicators.where((F.length("value") <= LONGEST) & ~F.col("value").isin(INFRASTRUCTURE))
    sums = rows.groupBy("type", "value").agg(F.countDistinct("member").alias("members"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.min("member").alias("first_member"))
    name = F.concat(F.lit("Shared "), F.col("type"), F.lit(": "), F.when(F.length("value") > NAME_LENGTH, F.concat(F.substring("value", 1, NAME_LENGTH), F.lit("…"))).otherwise(F.col("value")))
    return sums.where(F.col("members") >= least).withColumns({"fingerprint": fingerprint(F.col("type"), F.col("value")), "name": name})
