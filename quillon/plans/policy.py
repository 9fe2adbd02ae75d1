"""Policy queries. Exceptions are those orders of low priority whose key is divisible by five."""

from pyspark.sql import functions as F

from quillon.functions.core import FAMILIES
from quillon.operators import policy as P
from quillon.plans.dashboard import RANK
from quillon.plans.registry import query
from quillon.plans.scoring import FIRED, POINTS

AS_OF = "2001-08-02"
POLICIES = [
    {"name": "no-known-bad", "priority": 10, "action": "BLOCK", "enabled": True, "conditions": [{"type": "verdict_at_least", "verdict": "KNOWN_MALICIOUS"}, {"type": "rule_fired", "rule": "Q-INS-001"}]},
    {"name": "young", "priority": 20, "action": "WARN", "enabled": True, "conditions": [{"type": "package_age_below_days", "days": 2300}, {"type": "maintainer_count_below", "count": 3}]},
    {"name": "caps", "priority": 20, "action": "BLOCK", "enabled": True, "conditions": [{"type": "family_score_at_least", "family": "CAPABILITY", "score": 12.5}]},
    {"name": "license", "priority": 30, "action": "WARN", "enabled": True, "conditions": [{"type": "license_not_in", "licenses": ["Building ", "MACHINERY", "household"]}, {"type": "ecosystem_is", "ecosystem": "ASIA"}]},
    {"name": "off", "priority": 1, "action": "BLOCK", "enabled": False, "conditions": [{"type": "ecosystem_is", "ecosystem": "ASIA"}]},
    {"name": "empty", "priority": 2, "action": "BLOCK", "enabled": True, "conditions": []},
]

_SCORES = ", ".join(f"sum(CASE WHEN h.family = '{f}' AND enabled THEN weight * confidence * modifier ELSE 0 END) AS score_{f.lower()}" for f in FAMILIES)
SUBJECT = f"""sums AS (SELECT analysis_id, list(DISTINCT h.rule_id) AS fired, {_SCORES} FROM {FIRED} h LEFT JOIN rule USING (rule_id) GROUP BY 1),
  subject AS (SELECT a.analysis_id, a.package_id, a.org_id, verdict, license, ecosystem, coalesce(fired, []) AS fired, {", ".join(f"coalesce(score_{f.lower()}, 0) AS score_{f.lower()}" for f in FAMILIES)},
    a.package_id % 5 AS maintainers, first_published FROM analysis a JOIN package p USING (package_id) LEFT JOIN (SELECT package_id, min(published_at) AS first_published FROM release GROUP BY 1) USING (package_id) LEFT JOIN sums USING (analysis_id))"""
TESTS = {
    "caps": "score_capability >= 12.5",
    "license": "lower(trim(license)) NOT IN ('building', 'machinery', 'household') AND ecosystem = 'ASIA'",
    "no-known-bad": "verdict = 'KNOWN_MALICIOUS' AND list_contains(fired, 'Q-INS-001')",
    "young": f"epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(first_published) < 2300 * 86400000000 AND maintainers BETWEEN 1 AND 2",
}
ORDER = ["no-known-bad", "caps", "young", "license"]
ACTIONS = {p["name"]: p["action"] for p in POLICIES}
DECIDED = f"""{SUBJECT}, told AS (SELECT *, {" || ".join(f"(CASE WHEN {TESTS[n]} THEN ['{n}'] ELSE [] END)" for n in ORDER)} AS m FROM subject),
  decided AS (SELECT analysis_id, package_id, org_id, coalesce(CASE m[1] {" ".join(f"WHEN '{n}' THEN '{a}'" for n, a in ACTIONS.items())} END, 'ALLOW') AS action, m[1] AS policy, array_to_string(m, ',') AS matched FROM told)"""


def decisions(analysis, hit, rule, package, release):
    return P.decide(P.subjects(analysis, hit, rule, package.withColumn("maintainers", F.col("package_id") % 5), release, AS_OF), POLICIES)


@query(f"WITH {DECIDED} SELECT analysis_id, action, policy, matched FROM decided")
def policy_first_match(analysis, hit, rule, package, release):
    return decisions(analysis, hit, rule, package, release)


@query(f"WITH {DECIDED}, last AS (SELECT analysis_id FROM analysis WHERE completed_at IS NOT NULL ORDER BY completed_at DESC, analysis_id DESC LIMIT 500) SELECT action, policy, count(*) AS n FROM decided JOIN last USING (analysis_id) GROUP BY 1, 2")
def policy_preview(analysis, hit, rule, package, release):
    """What the policies would do to the 500 latest finished analyses."""
    last = analysis.where("completed_at is not null").orderBy(F.desc("completed_at"), F.desc("analysis_id")).limit(500)
    return decisions(last, hit.join(F.broadcast(last.select("analysis_id")), "analysis_id", "left_semi"), rule, package, release).groupBy("action", "policy").agg(F.count("*").alias("n"))


@query(f"""WITH {DECIDED}, last AS (SELECT * FROM analysis WHERE verdict IS NOT NULL AND completed_at IS NOT NULL ORDER BY completed_at DESC, analysis_id DESC LIMIT 500),
  m AS (SELECT l.analysis_id, l.verdict, l.completed_at, list_contains(string_split(matched, ','), 'young') AS own FROM decided JOIN last l USING (analysis_id)),
  s AS (SELECT * FROM m WHERE own ORDER BY completed_at DESC, analysis_id DESC LIMIT 25)
  SELECT 'WARN' AS action, count(*) AS evaluated, CAST(count_if(own) AS BIGINT) AS matched, (SELECT count(*) FROM analysis WHERE verdict IS NOT NULL AND completed_at IS NOT NULL) > count(*) AS truncated, 500 AS window,
    (SELECT string_agg(concat(analysis_id, ' ', verdict), ',' ORDER BY completed_at DESC, analysis_id DESC) FROM s) AS samples, 'package first published less than 2300 days ago; fewer than 3 maintainers' AS reasons FROM m""")
def policy_preview_samples(analysis, hit, rule, package, release):
    """What one policy would do to the 500 latest finished analyses, with the newest of those that it matches."""
    done = analysis.where("verdict is not null and completed_at is not null")
    last = done.orderBy(F.desc("completed_at"), F.desc("analysis_id")).limit(P.PREVIEWED)
    hits = hit.join(F.broadcast(last.select("analysis_id")), "analysis_id", "left_semi")
    seen = P.subjects(last, hits, rule, package.withColumn("maintainers", F.col("package_id") % 5), release, AS_OF)
    told = P.preview(next(p for p in POLICIES if p["name"] == "young"), seen, done.agg(F.count("*").alias("total")))
    shown = F.array_join(F.transform("samples", lambda x: F.concat_ws(" ", x["analysis_id"].cast("string"), x["verdict"])), ",")
    return told.select("action", "evaluated", "matched", "truncated", "window", F.when(F.size("samples") > 0, shown).alias("samples"), F.array_join("reasons", "; ").alias("reasons"))


@query(f"WITH {DECIDED} SELECT unnest(string_split(matched, ',')) AS policy, count(*) AS n FROM decided WHERE matched <> '' GROUP BY 1")
def policy_conditions_matrix(analysis, hit, rule, package, release):
    """How many subjects each policy matches, decisive or not."""
    return decisions(analysis, hit, rule, package, release).where("matched <> ''").select(F.explode(F.split("matched", ",")).alias("policy")).groupBy("policy").agg(F.count("*").alias("n"))


EXCEPTION = """exception AS (SELECT o_orderkey AS exception_id, CAST(c_nationkey AS BIGINT) AS org_id, o_custkey AS package_id, CASE o_orderstatus WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'REJECTED' ELSE 'APPROVED' END AS state,
  CASE WHEN o_orderkey % 10 = 0 THEN '*' ELSE 'caps' END AS policy, CASE WHEN o_orderkey % 15 <> 0 THEN o_orderdate + INTERVAL 30 DAY END AS expires_at FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '5-LOW' AND o_orderkey % 5 = 0)"""


def exceptions(orders, customer):
    owner = customer.select(F.col("c_custkey").alias("package_id"), F.col("c_nationkey").cast("long").alias("org_id"))
    state = F.when(F.col("o_orderstatus") == "O", "PENDING").when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("APPROVED")
    return (
        orders.where("o_orderpriority = '5-LOW' and o_orderkey % 5 = 0")
        .select(F.col("o_orderkey").alias("exception_id"), F.col("o_custkey").alias("package_id"), state.alias("state"), F.when(F.col("o_orderkey") % 10 == 0, "*").otherwise("caps").alias("policy"),
                F.when(F.col("o_orderkey") % 15 != 0, F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
        .join(owner, "package_id")
    )


@query(f"WITH {EXCEPTION} SELECT exception_id, org_id, package_id, policy, expires_at FROM exception WHERE state = 'APPROVED' AND (expires_at IS NULL OR expires_at > TIMESTAMP '2001-01-01') AND (policy = '*' OR policy = 'caps')")
def live_exceptions(orders, customer):
    live = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit("2001-01-01").cast("timestamp_ntz"))
    return exceptions(orders, customer).where((F.col("state") == "APPROVED") & live & (F.col("policy").isin("*", "caps"))).select("exception_id", "org_id", "package_id", "policy", "expires_at")


@query(f"WITH {EXCEPTION} SELECT exception_id, package_id, expires_at, state = 'APPROVED' AND expires_at <= TIMESTAMP '2001-01-01' AS lapsed, state = 'APPROVED' AND expires_at > TIMESTAMP '2001-01-01' AND expires_at <= TIMESTAMP '2001-01-08' AS expiring FROM exception WHERE expires_at IS NOT NULL")
def exceptions_expiring(orders, customer):
    """Lapsed exceptions, and those that lapse within a week."""
    at, week = (F.lit(x).cast("timestamp_ntz") for x in ("2001-01-01", "2001-01-08"))
    good, e = F.col("state") == "APPROVED", F.col("expires_at")
    return exceptions(orders, customer).where(e.isNotNull()).select("exception_id", "package_id", "expires_at", (good & (e <= at)).alias("lapsed"), (good & (e > at) & (e <= week)).alias("expiring"))


ENFORCED = f"""{DECIDED}, {EXCEPTION}, violation AS (SELECT d.analysis_id, d.org_id, d.package_id, d.policy, d.action,
  CASE WHEN EXISTS (SELECT 1 FROM exception e WHERE e.org_id = d.org_id AND e.package_id = d.package_id AND e.state = 'APPROVED' AND (e.expires_at IS NULL OR e.expires_at > TIMESTAMP '2001-01-01') AND (e.policy = '*' OR e.policy = d.policy)) THEN 'EXCEPTED' ELSE 'OPEN' END AS state,
  d.action = 'BLOCK' AS hold FROM decided d WHERE d.action <> 'ALLOW')"""


@query(f"WITH {ENFORCED} SELECT * FROM violation")
def policy_enforcement(analysis, hit, rule, package, release, orders, customer):
    return P.enforced(decisions(analysis, hit, rule, package, release), analysis, exceptions(orders, customer), "2001-01-01")


@query(f"WITH {ENFORCED} SELECT policy, count(*) AS total, CAST(count_if(state = 'OPEN') AS BIGINT) AS open, CAST(count_if(state = 'EXCEPTED') AS BIGINT) AS excepted FROM violation GROUP BY 1")
def violation_inbox_counts(analysis, hit, rule, package, release, orders, customer):
    rows = P.enforced(decisions(analysis, hit, rule, package, release), analysis, exceptions(orders, customer), "2001-01-01")
    return rows.groupBy("policy").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "OPEN").alias("open"), F.count_if(F.col("state") == "EXCEPTED").alias("excepted"))
