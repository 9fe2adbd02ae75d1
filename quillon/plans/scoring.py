"""Queries over rule hits."""

from pyspark.sql import functions as F

from quillon.operators import scoring
from quillon.plans.registry import query

FIRED = "(SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY analysis_id, rule_id ORDER BY weight DESC, line, confidence DESC, file_path, modifier DESC) = 1)"
POINTS = "sum(CASE WHEN enabled THEN weight * confidence * modifier ELSE 0 END)"


def _holds(groups) -> str:
    return " AND ".join("(" + " OR ".join(f"list_contains(fired, '{r}')" for r in g) + ")" for g in groups)


_TRIGGERS = " || ".join(f"(CASE WHEN {_holds(g)} THEN ['{t}'] ELSE [] END)" for t, g in sorted(scoring.TRIGGERS.items()))


@query(f"""
WITH sums AS (SELECT analysis_id, {POINTS} AS total, avg(confidence) AS mean, count(DISTINCT h.family) AS families, count(*) AS n, list(h.rule_id) AS fired
              FROM {FIRED} h LEFT JOIN rule USING (rule_id) GROUP BY analysis_id),
rows AS (SELECT a.analysis_id, a.org_id, a.status, coalesce(total, 0) AS total, mean, coalesce(families, 0) AS families, coalesce(n, 0) AS n, coalesce(fired, []) AS fired FROM analysis a LEFT JOIN sums USING (analysis_id)),
told AS (SELECT *, {_TRIGGERS} AS triggers, CASE WHEN total >= 100 THEN 0 WHEN total >= 55 THEN 1 WHEN total >= 28 THEN 2 WHEN total >= 10 THEN 3 ELSE 4 END AS scored,
         CASE WHEN n = 0 THEN 0.9 ELSE mean + 0.08 * (families - 1) END - CASE WHEN status = 'PARTIAL' THEN 0.12 ELSE 0.0 END AS sure FROM rows)
SELECT analysis_id, org_id, floor(total * 1e4 + 0.5) / 1e4 AS score, array_to_string(triggers, ',') AS triggers, CAST(n AS BIGINT) AS rules_fired,
       floor(greatest(0.1, least(1.0, CAST(sure AS DOUBLE))) * 1e4 + 0.5) / 1e4 AS confidence,
       (['KNOWN_MALICIOUS', 'LIKELY_MALICIOUS', 'SUSPICIOUS', 'LOW_RISK', 'CLEAN'])[1 + CASE WHEN len(triggers) > 0 THEN least(scored, 1) ELSE scored END] AS verdict,
       CASE WHEN len(triggers) > 0 AND scored > 1 THEN 'hard-trigger' ELSE 'weighted-score' END AS decided_by FROM told
""")
def verdict_scorecard(analysis, hit, rule):
    return scoring.scorecard(analysis, hit, rule)


@query(" UNION ALL ".join(f"SELECT analysis_id, '{t}' AS trigger FROM (SELECT analysis_id, list(DISTINCT rule_id) AS fired FROM hit GROUP BY analysis_id) WHERE {_holds(g)}" for t, g in scoring.TRIGGERS.items()))
def hard_trigger_hits(hit):
    return scoring.trigger_hits(hit)


_PARTS = ", ".join(f"('{t}', {k}, '{r}')" for t, groups in scoring.TRIGGERS.items() for k, g in enumerate(groups) for r in g)
_SIZES = ", ".join(f"('{t}', {len(g)})" for t, g in scoring.TRIGGERS.items())


@query(f"""
WITH parts AS (SELECT * FROM (VALUES {_PARTS}) t(trigger, part, rule_id)), sizes AS (SELECT * FROM (VALUES {_SIZES}) t(trigger, n)),
used AS (SELECT DISTINCT analysis_id, trigger, part, rule_id FROM hit JOIN parts USING (rule_id)),
groups AS (SELECT analysis_id, trigger, part, list(rule_id) AS rules, count(DISTINCT substring(rule_id, 1, 5)) AS prefixes FROM used GROUP BY ALL),
whole AS (SELECT analysis_id, trigger, count(*) AS n, list_sort(flatten(list(CASE WHEN len(rules) = 1 THEN rules ELSE [] END))) AS necessary,
                 list_sort(flatten(list(CASE WHEN prefixes = 1 THEN rules ELSE [] END))) AS families FROM groups GROUP BY ALL)
SELECT analysis_id, trigger, array_to_string(CASE WHEN len(necessary) > 0 THEN necessary ELSE families END, ',') AS rules FROM whole JOIN sizes USING (trigger, n)
""")
def load_bearing_rules(hit):
    return scoring.load_bearing(hit)


_SEVERITY = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"
_WORST = "(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'])[1 + worst]"


@query(f"""
WITH sums AS (SELECT analysis_id, f.family, count(*) AS n, {POINTS} AS total, min({_SEVERITY}) AS worst FROM {FIRED} f JOIN rule USING (rule_id) GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT analysis_id FROM hit) CROSS JOIN (SELECT family, count_if(enabled) AS rules_enabled FROM rule GROUP BY family))
SELECT analysis_id, family, CAST(rules_enabled AS BIGINT) AS rules_enabled, CAST(coalesce(n, 0) AS BIGINT) AS rules_fired, floor(coalesce(total, 0) * 100 + 0.5) / 100 AS contribution, {_WORST} AS worst_severity
FROM grid LEFT JOIN sums USING (analysis_id, family)
""")
def family_breakdown(hit, rule):
    return scoring.family_breakdown(hit, rule)


@query(f"""
WITH once AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY analysis_id, file_path, rule_id ORDER BY weight DESC, line, confidence DESC, file_path, modifier DESC) = 1),
sums AS (SELECT analysis_id, file_path, count(*) AS rules, count(DISTINCT o.family) AS families, {POINTS} AS risk FROM once o JOIN rule USING (rule_id) GROUP BY ALL),
worst AS (SELECT analysis_id, file_path, min({_SEVERITY}) AS worst FROM hit GROUP BY ALL),
lines AS (SELECT analysis_id, file_path, count(DISTINCT spot) AS n FROM (SELECT analysis_id, file_path, unnest(range(line_start, least(line_end, line_start + 499) + 1)) AS spot FROM hit) GROUP BY ALL)
SELECT analysis_id, file_path, CAST(rules AS BIGINT) AS rules, CAST(families AS BIGINT) AS families, floor(risk * 100 + 0.5) / 100 AS risk, {_WORST} AS worst_severity, CAST(n AS BIGINT) AS flagged_lines
FROM sums JOIN worst USING (analysis_id, file_path) JOIN lines USING (analysis_id, file_path)
""")
def file_risk_inventory(hit, rule):
    return scoring.file_risk(hit, rule)


@query("""SELECT rule_id, CAST(count(*) AS BIGINT) AS hits, CAST(count(DISTINCT analysis_id) AS BIGINT) AS analyses, CAST(count(DISTINCT package_id) AS BIGINT) AS packages,
          CAST(count(DISTINCT CASE WHEN verdict IN ('CLEAN', 'LOW_RISK') THEN analysis_id END) AS BIGINT) AS benign FROM hit JOIN analysis USING (analysis_id) GROUP BY rule_id""")
def rule_stats(hit, analysis):
    """How often each rule fired, and on how many benign analyses."""
    return scoring.rule_stats(hit, analysis)


@query("""SELECT r.rule_id, r.family, r.enabled, CAST(coalesce(n, 0) AS BIGINT) AS firings FROM rule r LEFT JOIN (SELECT rule_id, count(*) AS n FROM hit GROUP BY 1) USING (rule_id)""")
def rule_catalogue_coverage(hit, rule):
    return F.broadcast(rule).join(hit.groupBy("rule_id").agg(F.count("*").alias("firings")), "rule_id", "left").select("rule_id", "family", "enabled", F.coalesce("firings", F.lit(0)).alias("firings"))


@query("""SELECT rule_id, analysis_id, CAST(count(*) AS BIGINT) AS hits, min({'l': line, 'f': file_path}).f AS sample_file, min(line) AS sample_line FROM hit GROUP BY ALL""")
def rule_firings(hit):
    return hit.groupBy("rule_id", "analysis_id").agg(F.count("*").alias("hits"), F.min(F.struct("line", "file_path"))["file_path"].alias("sample_file"), F.min("line").alias("sample_line"))


@query("""SELECT analysis_id, rule_id, line, file_path, CAST(position AS BIGINT) AS position FROM
          (SELECT *, row_number() OVER (PARTITION BY analysis_id, rule_id ORDER BY confidence DESC, line, file_path, weight) AS position FROM hit) WHERE position <= 25""")
def evidence_capped(hit):
    from quillon.functions.core import top_per

    return top_per(hit, ["analysis_id", "rule_id"], 25, F.desc("confidence"), F.asc("line"), F.asc("file_path"), F.asc("weight")).select("analysis_id", "rule_id", "line", "file_path", F.col("position").cast("long").alias("position"))


@query("""SELECT analysis_id, CAST(count(DISTINCT CASE WHEN family = 'INSTALL' THEN rule_id END) AS BIGINT) AS install, CAST(count(DISTINCT CASE WHEN family = 'OBFUSCATION' THEN rule_id END) AS BIGINT) AS obfuscation,
          CAST(count(DISTINCT CASE WHEN family = 'CAPABILITY' THEN rule_id END) AS BIGINT) AS capability FROM hit GROUP BY 1""")
def signal_counts(hit):
    """Distinct fired rules of a family for each analysis."""
    return scoring.signal_counts(hit, ["INSTALL", "OBFUSCATION", "CAPABILITY"])
