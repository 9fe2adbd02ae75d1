"""The rules with their weights, severities and what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rules, weights and severities. What a rule says is worded here.
RULES = [
    ("Q-INS-001", 3, "MEDIUM", "runs a script when it is installed"),
    ("Q-INS-002", 9, "CRITICAL", "install script calls a shell or an interpreter"),
    ("Q-INS-003", 9, "CRITICAL", "install script decodes something"),
    ("Q-INS-004", 10, "CRITICAL", "install script touches credentials"),
    ("Q-INS-005", 8, "HIGH", "install script uses the network"),
    ("Q-INS-006", 9, "CRITICAL", "install script writes outside its folder"),
    ("Q-INS-007", 7, "HIGH", "install script runs an obfuscated file"),
    ("Q-OBF-001", 4, "MEDIUM", "random-looking literal"),
    ("Q-OBF-002", 6, "HIGH", "long encoded run"),
    ("Q-OBF-003", 7, "HIGH", "evaluates text or computes a module's name"),
    ("Q-OBF-004", 7, "HIGH", "table of encoded strings or generated names"),
    ("Q-OBF-005", 8, "CRITICAL", "hidden or reordering characters"),
    ("Q-OBF-006", 4, "MEDIUM", "packed without saying so"),
    ("Q-OBF-007", 6, "HIGH", "text put together piece by piece"),
    ("Q-CAP-001", 5, "MEDIUM", "starts processes"),
    ("Q-CAP-002", 5, "MEDIUM", "uses raw network modules"),
    ("Q-CAP-003", 6, "HIGH", "runs code in other contexts or threads"),
    ("Q-CAP-004", 8, "CRITICAL", "reads the whole environment"),
    ("Q-CAP-005", 9, "CRITICAL", "names files with credentials"),
    ("Q-CAP-006", 9, "CRITICAL", "names wallets"),
    ("Q-CAP-007", 7, "HIGH", "calls a fixed address"),
    ("Q-CAP-008", 9, "CRITICAL", "sends to an endpoint that collects data"),
    ("Q-CAP-009", 7, "HIGH", "native files that it doesn't declare"),
    ("Q-TYP-001", 4, "MEDIUM", "name near a popular one"),
    ("Q-TYP-002", 7, "HIGH", "name with characters that look like others"),
    ("Q-TYP-003", 5, "MEDIUM", "name of a popular one with other separators"),
    ("Q-TYP-004", 6, "HIGH", "scope that imitates another"),
    ("Q-TYP-005", 4, "MEDIUM", "popular name with an addition"),
    ("Q-TYP-006", 6, "HIGH", "reads as an internal package"),
    ("Q-MNT-001", 4, "MEDIUM", "new release after a long silence"),
    ("Q-MNT-002", 6, "HIGH", "released by a new maintainer"),
    ("Q-MNT-003", 4, "MEDIUM", "maintainer's account is young or little used"),
    ("Q-MNT-004", 2, "LOW", "one maintainer of a widely used package"),
    ("Q-MNT-005", 4, "MEDIUM", "version jumps or goes back"),
    ("Q-MNT-006", 3, "LOW", "release out of the usual rhythm"),
    ("Q-PRV-001", 3, "LOW", "names no repository"),
    ("Q-PRV-002", 4, "MEDIUM", "repository can't be read or is archived"),
    ("Q-PRV-003", 10, "CRITICAL", "executable files that the repository lacks"),
    ("Q-PRV-004", 8, "HIGH", "files differ from the repository's"),
    ("Q-PRV-005", 6, "HIGH", "large binary that it doesn't declare"),
    ("Q-PRV-006", 1, "INFO", "no attestation"),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """(rule_id, weight, severity, says) of all 41 rules, to be broadcast."""
    return spark.createDataFrame(RULES, "rule_id string, weight int, severity string, says string")


SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{r}', {w}, '{s}', '{t.replace(chr(39), chr(39) * 2)}')" for r, w, s, t in RULES) + ") t(rule_id, weight, severity, says)"
