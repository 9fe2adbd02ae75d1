"""Rate limits, audit log, changes, dependency graph and exports."""

from pyspark.sql import functions as F

from quillon.functions.core import VERDICTS, page
from quillon.functions.folders import materialise
from quillon.operators import changes as D
from quillon.operators import exports as X
from quillon.operators import graph as G
from quillon.operators import limits as L
from quillon.plans.dashboard import NAMES
from quillon.plans.registry import query

_W = "OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)"


@query(f"""WITH w AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, count(*) {_W} AS used, min(epoch_us(ts)) {_W} AS oldest FROM events)
  SELECT event_id, user_id, event_type, used, CAST(greatest(2 - used, 0) AS BIGINT) AS remaining, CAST(CASE WHEN used >= 2 THEN ceil((oldest + 86400000000 - us) / 1000000) ELSE 0 END AS BIGINT) AS retry_after_s FROM w""")
def rate_limit_sliding(events):
    return L.sliding(events, ["user_id", "event_type"], "ts", "event_id", 86_400, 2)


@query(f"""WITH w AS (SELECT user_id, event_type, count(*) {_W} AS used FROM events) SELECT user_id, event_type, max(used) AS most, CAST(count_if(used >= 2) AS BIGINT) AS denied FROM w GROUP BY 1, 2 HAVING count_if(used >= 2) > 0""")
def rate_limit_retry_after(events):
    """Buckets that ran into their limit."""
    rows = L.sliding(events, ["user_id", "event_type"], "ts", "event_id", 86_400, 2)
    return rows.groupBy("user_id", "event_type").agg(F.max("used").alias("most"), F.count_if(F.col("used") >= 2).alias("denied")).where("denied > 0")


FAILURES = """s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
  f AS (SELECT event_id, user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS failures FROM s)"""


def failures(events):
    return L.streaks(events, ["user_id"], F.col("event_type") != "error", F.col("ts"), F.col("event_id")).select("event_id", "user_id", "failures")


@query(f"WITH {FAILURES} SELECT event_id, user_id, CAST(failures AS BIGINT) AS failures FROM f")
def failure_streaks(events):
    return failures(events)


@query(f"WITH {FAILURES} SELECT event_id, user_id, CAST(failures * 3 AS BIGINT) AS failures, CAST(CASE WHEN failures * 3 < 5 THEN 0 ELSE least(pow(2, least(failures * 3 - 5, 32)) * 60000, 86400000) END AS BIGINT) AS lockout_ms FROM f WHERE failures > 0")
def lockout_backoff(events):
    """Lockout after each failure, where each counts three times."""
    rows = failures(events).where("failures > 0").withColumn("failures", F.col("failures") * 3)
    return rows.withColumn("lockout_ms", L.lockout_ms(F.col("failures")))


@query("SELECT event_id, ts, user_id, event_type, (SELECT count(*) FROM events WHERE event_type IN ('error', 'signup')) AS total FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50")
def audit_page(events):
    own = events.where(F.col("event_type").isin("error", "signup"))
    rows = page(own.select("event_id", "ts", "user_id", "event_type"), 2, 50, F.desc("ts"), F.desc("event_id"))
    return rows.crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))  # one row


@query("SELECT event_type AS action, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1")
def audit_distinct_actions(events):
    return events.groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, CAST(count_if(CAST(json_extract(props, '$.k') AS BIGINT) > 50) AS BIGINT) AS large FROM events GROUP BY 1")
def json_props_counts(events):
    rows = events.withColumn("p", F.from_json("props", "k long"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k"), F.count_if(F.col("p.k") > 50).alias("large"))


@query("SELECT analysis_id, CASE WHEN status = 'QUEUED' AND created_at < TIMESTAMP '1998-01-01' THEN 'FAILED' ELSE status END AS status FROM analysis")
def stalled_reclaim(analysis):
    late = (F.col("status") == "QUEUED") & (F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return D.update_where(analysis.select("analysis_id", "status", "created_at"), late, status="FAILED").drop("created_at")


@query("WITH o AS (SELECT package_id, license FROM package WHERE package_id % 3 <> 0), n AS (SELECT package_id, 'NEW' AS license FROM package WHERE package_id % 2 = 0) SELECT * FROM o WHERE package_id NOT IN (SELECT package_id FROM n) UNION ALL SELECT * FROM n")
def upsert_catalogue(package):
    old = package.where("package_id % 3 <> 0").select("package_id", "license")
    return D.upsert(old, package.where("package_id % 2 = 0").select("package_id", F.lit("NEW").alias("license")), ["package_id"])


@query("WITH o AS (SELECT package_id, license FROM package WHERE package_id % 3 <> 0), n AS (SELECT package_id, 'NEW' AS license FROM package WHERE package_id % 2 = 0) SELECT * FROM o UNION ALL SELECT * FROM n WHERE package_id NOT IN (SELECT package_id FROM o)")
def insert_if_absent(package):
    old = package.where("package_id % 3 <> 0").select("package_id", "license")
    return D.insert_missing(old, package.where("package_id % 2 = 0").select("package_id", F.lit("NEW").alias("license")), ["package_id"])


@query("WITH n AS (SELECT analysis_id, 'Q-NEW-001' AS rule_id FROM analysis WHERE analysis_id % 4 = 0) SELECT analysis_id, rule_id FROM hit WHERE analysis_id NOT IN (SELECT analysis_id FROM n) UNION ALL SELECT * FROM n")
def replace_children(hit, analysis):
    new = analysis.where("analysis_id % 4 = 0").select("analysis_id", F.lit("Q-NEW-001").alias("rule_id"))
    return D.replace_children(hit.select("analysis_id", "rule_id"), new, "analysis_id")


@query("WITH c AS (SELECT analysis_id FROM analysis WHERE status = 'QUEUED' ORDER BY created_at, analysis_id LIMIT 5) SELECT analysis_id, CASE WHEN analysis_id IN (SELECT analysis_id FROM c) THEN 'RUNNING' ELSE status END AS status FROM analysis")
def queue_claim(analysis):
    rows = analysis.select("analysis_id", "status")
    return D.update_join(rows, D.claim(analysis, 5, F.asc("created_at"), F.asc("analysis_id")), ["analysis_id"], status="RUNNING")


@query("SELECT event_id, ts FROM events WHERE NOT ts < TIMESTAMP '2024-01-15'")
def retention_delete(events):
    return D.delete_where(events.select("event_id", "ts"), F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))


BFS = f"""e AS (SELECT * FROM edge), r AS (SELECT DISTINCT parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e)), d1 AS (SELECT child AS node, 1 AS depth, min(parent) AS parent FROM e WHERE parent IN (SELECT node FROM r) AND child NOT IN (SELECT node FROM r) GROUP BY 1),
  d2 AS (SELECT child AS node, 2 AS depth, min(parent) AS parent FROM e WHERE parent IN (SELECT node FROM d1) AND child NOT IN (SELECT node FROM r UNION ALL SELECT node FROM d1) GROUP BY 1),
  d3 AS (SELECT child AS node, 3 AS depth, min(parent) AS parent FROM e WHERE parent IN (SELECT node FROM d2) AND child NOT IN (SELECT node FROM r UNION ALL SELECT node FROM d1 UNION ALL SELECT node FROM d2) GROUP BY 1),
  tree AS (SELECT node, 0 AS depth, NULL AS parent FROM r UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3),
  told AS (SELECT *, CASE WHEN node % 6 < 5 THEN ({NAMES})[1 + node % 6] END AS verdict FROM tree),
  up AS (SELECT t.node AS leaf, t.node, verdict FROM told t UNION ALL SELECT t.node, t.parent, verdict FROM told t WHERE depth > 0 UNION ALL SELECT t.node, p.parent, t.verdict FROM told t JOIN tree p ON p.node = t.parent WHERE p.depth > 0
    UNION ALL SELECT t.node, q.parent, t.verdict FROM told t JOIN tree p ON p.node = t.parent JOIN tree q ON q.node = p.parent WHERE q.depth > 0)"""
_RANK = "list_position(" + NAMES + ", verdict) - 1"


def tree(edge):
    """From every parent that is nobody's child."""
    edge = materialise(edge, "edges")  # every round reads it
    return G.depths(edge, G.roots(edge))


def told(edge):
    verdict = F.when(F.col("node") % 6 < 5, F.element_at(F.array(*map(F.lit, VERDICTS)), (F.col("node") % 6 + 1).cast("int")))
    return G.paths(tree(edge)).withColumn("verdict", verdict)


@query(f"WITH {BFS} SELECT node, depth, parent FROM tree")
def dependency_depth_bfs(edge):
    return tree(edge)


@query(f"WITH {BFS} SELECT node, count(*) AS subtree, CAST(count_if(coalesce({_RANK} <= 2, false)) AS BIGINT) AS flagged, ({NAMES})[1 + min({_RANK})] AS worst FROM up GROUP BY 1")
def dependency_tree_rollup(edge):
    return G.rollup(told(edge))


@query(f"WITH {BFS} SELECT count(*) AS total, CAST(count_if(depth <= 1) AS BIGINT) AS direct, CAST(count_if(depth > 1) AS BIGINT) AS transitive, count(verdict) AS analysed, count(*) - count(verdict) AS unanalysed, CAST(count_if(coalesce({_RANK} <= 2, false)) AS BIGINT) AS flagged, ({NAMES})[1 + min({_RANK})] AS worst FROM told")
def dependency_risk_summary(edge):
    return G.risk_summary(told(edge))


@query(f"WITH {BFS} SELECT node, depth FROM tree WHERE node IN (SELECT node FROM up WHERE leaf % 50 = 7)")
def dependency_tree_filter(edge):
    nodes = told(edge)
    return G.keep_ancestors(nodes, nodes.where("node % 50 = 7")).select("node", "depth")


@query("""SELECT p_partkey, concat('"', replace(CASE WHEN regexp_matches(v, '^[=+@\\t\\r-]') THEN concat('''', v) ELSE v END, '"', '""'), '"') AS cell FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('=', p_name) WHEN 1 THEN concat('"', p_name) WHEN 2 THEN concat('-', p_name) ELSE p_name END AS v FROM part)""")
def csv_guard(part):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    v = F.when(k == 0, F.concat(F.lit("="), n)).when(k == 1, F.concat(F.lit('"'), n)).when(k == 2, F.concat(F.lit("-"), n)).otherwise(n)
    return part.select("p_partkey", X.csv_cell(v).alias("cell"))


@query("SELECT p_partkey, concat('pkg:npm/', replace(p_brand, '#', '%23'), '/', replace(p_name, ' ', '%20'), '@', p_size, '.0.0') AS purl FROM part")
def purl(part):
    return part.select("p_partkey", X.package_url(F.lit("npm"), F.concat_ws("/", "p_brand", "p_name"), F.concat(F.col("p_size").cast("string"), F.lit(".0.0"))).alias("purl"))


@query("SELECT p_partkey, substring(regexp_replace(regexp_replace(lower(concat(p_brand, ' ', p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug FROM part")
def slug(part):
    return part.select("p_partkey", X.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query()
def sbom_document(edge):
    """One document for each root, with all that it reaches; as JSON text it has no SQL counterpart, and tests read it back."""
    edge = materialise(edge, "edges")  # every round reads it
    nodes = G.reached(edge, G.roots(edge))
    return X.sbom(nodes.select("root", F.concat(F.lit("node-"), F.col("node").cast("string")).alias("name"), F.lit("1.0.0").alias("version")), "root")
