"""Lists that people work on, coordinates and links, and what remains of queues and graphs."""

from pyspark.sql import functions as F

from quillon.functions import coordinates as K
from quillon.functions.core import SEVERITIES, VERDICTS
from quillon.functions.folders import materialise
from quillon.operators import changes as D
from quillon.operators import governance as V
from quillon.operators import graph as G
from quillon.operators import policy as P
from quillon.operators import scoring
from quillon.plans.dashboard import NAMES
from quillon.plans.policy import ENFORCED, decisions, exceptions
from quillon.plans.registry import query

LATEST = "latest AS (SELECT package_id, verdict FROM analysis QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY completed_at DESC NULLS FIRST, analysis_id DESC) = 1)"


def violations(analysis, hit, rule, package, release, orders, customer):
    return P.enforced(decisions(analysis, hit, rule, package, release), analysis, exceptions(orders, customer), "2001-01-01")


@query(f"""WITH {ENFORCED}, {LATEST} SELECT org_id, package_id, policies, violations, verdict FROM (SELECT org_id, package_id, coalesce(string_agg(DISTINCT CASE WHEN state = 'OPEN' THEN policy END, ',' ORDER BY CASE WHEN state = 'OPEN' THEN policy END), '') AS policies, count(*) AS violations FROM violation WHERE hold GROUP BY 1, 2)
  LEFT JOIN latest USING (package_id)""")
def held_packages(analysis, hit, rule, package, release, orders, customer):
    return V.held(violations(analysis, hit, rule, package, release, orders, customer), analysis)


@query(f"WITH {ENFORCED} SELECT p.package_id, p.org_id, EXISTS (SELECT 1 FROM violation v WHERE v.hold AND v.package_id = p.package_id AND v.org_id = p.org_id) AS held FROM package p")
def package_held_flag(analysis, hit, rule, package, release, orders, customer):
    own = violations(analysis, hit, rule, package, release, orders, customer).where("hold")
    return V.is_held(package.select("package_id", "org_id"), own, ["package_id", "org_id"])


@query(f"""WITH {ENFORCED}, s AS (SELECT v.*, EXISTS (SELECT 1 FROM exception e WHERE e.org_id = v.org_id AND e.package_id = v.package_id AND e.state = 'APPROVED' AND (e.expires_at IS NULL OR e.expires_at > TIMESTAMP '2001-12-01') AND (e.policy = '*' OR e.policy = v.policy)) AS live FROM violation v)
  SELECT analysis_id, policy, org_id, package_id, CASE WHEN state = 'EXCEPTED' AND NOT live THEN 'OPEN' ELSE state END AS state, state = 'EXCEPTED' AND NOT live AS reopened FROM s""")
def expiry_sweep(analysis, hit, rule, package, release, orders, customer):
    return V.sweep(violations(analysis, hit, rule, package, release, orders, customer), exceptions(orders, customer), "2001-12-01")


@query(f"""WITH {ENFORCED} SELECT v.analysis_id, v.policy, v.state, a.verdict, a.completed_at FROM violation v LEFT JOIN (SELECT analysis_id, verdict, completed_at FROM analysis WHERE status <> 'QUEUED') a USING (analysis_id) WHERE v.state = 'OPEN' ORDER BY v.analysis_id DESC, v.policy LIMIT 50""")
def violation_inbox(analysis, hit, rule, package, release, orders, customer):
    """The newest open violations, with the finished analysis where there is one."""
    own = violations(analysis, hit, rule, package, release, orders, customer).where("state = 'OPEN'").orderBy(F.desc("analysis_id"), "policy").limit(50)
    done = analysis.where("status <> 'QUEUED'").select("analysis_id", "verdict", "completed_at")
    return V.with_optional(own.select("analysis_id", "policy", "state"), done, "analysis_id", ["verdict", "completed_at"])


ALERTS = """alert AS (SELECT event_id AS alert_id, user_id % 25 AS org_id, event_type AS type, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS resolved_at, CASE WHEN event_id % 2 = 0 THEN ts END AS read_at FROM events)"""


def alerts(events):
    k = F.col("event_id")
    return events.select(k.alias("alert_id"), (F.col("user_id") % 25).alias("org_id"), F.col("event_type").alias("type"), F.col("ts").alias("created_at"), F.when(k % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("resolved_at"), F.when(k % 2 == 0, F.col("ts")).alias("read_at"))


@query(f"WITH {ALERTS} SELECT alert_id, type, created_at FROM alert WHERE org_id = 3 AND resolved_at IS NULL ORDER BY created_at DESC, alert_id DESC LIMIT 100")
def alerts_open(events):
    return V.alerts(alerts(events).where("org_id = 3"), False).select("alert_id", "type", "created_at").limit(100)


@query(f"WITH {ALERTS} SELECT org_id, count(*) AS total, CAST(count_if(resolved_at IS NULL) AS BIGINT) AS unresolved, CAST(count_if(read_at IS NULL) AS BIGINT) AS unread FROM alert GROUP BY 1")
def alert_counts(events):
    return V.alert_counts(alerts(events), ["org_id"])


@query("SELECT event_id, event_type, ts, c_name AS actor FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0")
def audit_with_actor(events, customer):
    """Audit entries with the actor's name, where the actor is known."""
    known = customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("actor"))
    return V.with_optional(events.select("event_id", "event_type", "ts", "user_id"), known, "user_id", ["actor"]).drop("user_id")


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(concat_ws(chr(0), p_name, p_type)), 'bolt') AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#31', 'Brand#32', 'Brand#41')")
def facet_filter(part):
    return V.facets(part, "BOLT", ["p_name", "p_type"], {"p_brand": ["Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22", "Brand#31", "Brand#32", "Brand#41"], "p_size": []}).select("p_partkey", "p_name", "p_brand")


@query("SELECT p_partkey, key, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY key, p_partkey) AS BIGINT) AS position FROM (SELECT p_partkey, p_brand, array_to_string(list_transform(regexp_extract_all(lower(concat(p_name, ' v', p_size, '.', p_partkey % 12)), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '') AS key FROM part)")
def natural_sort(part):
    from pyspark.sql import Window

    text = F.concat("p_name", F.lit(" v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 12).cast("string"))
    rows = part.select("p_partkey", "p_brand", V.natural(text).alias("key"))
    return rows.select("p_partkey", "key", F.row_number().over(Window.partitionBy("p_brand").orderBy("key", "p_partkey")).cast("long").alias("position"))


@query("SELECT analysis_id, package_id FROM analysis WHERE (org_id, package_id % 10, verdict) IN (SELECT DISTINCT CAST(c_nationkey AS BIGINT), c_custkey % 10, 'CLEAN' FROM customer WHERE c_custkey % 9 = 0)")
def tuple_in_list(analysis, customer):
    """Rows whose three columns together are listed."""
    listed = customer.where("c_custkey % 9 = 0").select(F.col("c_nationkey").cast("long").alias("org_id"), (F.col("c_custkey") % 10).alias("d"), F.lit("CLEAN").alias("verdict")).distinct()
    return analysis.withColumn("d", F.col("package_id") % 10).join(listed, ["org_id", "d", "verdict"], "left_semi").select("analysis_id", "package_id")


@query("SELECT DISTINCT package_id, actor FROM (SELECT o_custkey AS package_id, o_orderkey % 13 AS actor, CASE WHEN o_orderkey % 5 = 0 THEN 'REMOVED' ELSE 'ADDED' END AS type FROM orders) WHERE type <> 'REMOVED'")
def maintainers_of(orders):
    """Everyone with an event other than a removal."""
    kind = F.when(F.col("o_orderkey") % 5 == 0, "REMOVED").otherwise("ADDED")
    return orders.where(kind != "REMOVED").select(F.col("o_custkey").alias("package_id"), (F.col("o_orderkey") % 13).alias("actor")).distinct()


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS total, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 1 THEN 2 ELSE 0 END AS flagged,
  CASE WHEN event_id % 4 = 1 THEN 'CLEAN' END AS worst, CASE WHEN event_id % 4 = 1 THEN 7 END AS clean FROM events""")
def tolerant_risk(events):
    """Cached summaries, of which some lack fields, have unknown verdicts or are no summaries."""
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"total": '), k, F.lit(', "worstVerdict": "ODD"}')))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"flagged": 2, "total": '), k, F.lit(', "worstVerdict": "CLEAN", "byVerdict": {"CLEAN": 7, "ODD": 1}}')))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"total": '), k, F.lit("}")))
        .otherwise('["total"]')
    )
    rows = events.select("event_id", V.risk_of(text, VERDICTS).alias("r"))
    return rows.select("event_id", "r.total", F.col("r.flagged").cast("int").alias("flagged"), "r.worst", F.col("r.by_verdict")["CLEAN"].cast("int").alias("clean"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('@s/', p_partkey) WHEN 1 THEN concat('@s', p_partkey) WHEN 2 THEN concat('n', p_partkey) ELSE concat('n', p_partkey, '@') END AS name, CASE WHEN p_partkey % 4 IN (0, 2) THEN concat(p_size, '.0') END AS version FROM part""")
def coordinates(part):
    k, n, v = F.col("p_partkey") % 4, F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.when(k == 0, F.concat(F.lit(" npm:@s/"), n, F.lit("@"), v, F.lit(".0 "))).when(k == 1, F.concat(F.lit("@s"), n)).when(k == 2, F.concat(F.lit("n"), n, F.lit("@"), v, F.lit(".0"))).otherwise(F.concat(F.lit("n"), n, F.lit("@")))
    return part.select("p_partkey", K.split_coordinate(text).alias("c")).select("p_partkey", "c.name", "c.version")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'code.example' END AS host, CASE WHEN p_partkey % 3 < 2 THEN concat('o', p_size) END AS owner, CASE WHEN p_partkey % 3 < 2 THEN concat('r.', p_partkey) END AS repo FROM part""")
def repository_refs(part):
    n, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    url = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("git+https://me@Code.example:443/o"), size, F.lit("/r."), n, F.lit(".git"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("https://code.example/o"), size, F.lit("/r."), n, F.lit("/tree/main"))).otherwise("https://code.example/../x")
    return part.select("p_partkey", K.repository(url).alias("r")).select("p_partkey", "r.host", "r.owner", "r.repo")


@query("SELECT p_partkey, concat('/packages/npm/', replace(replace(p_brand, '#', '%23'), ' ', '%20'), '%2F', replace(p_name, ' ', '%20'), '/', p_size, '.0') AS link, concat(p_brand, '/', p_name) AS name FROM part")
def package_links(part):
    name = F.concat_ws("/", "p_brand", "p_name")
    return part.select("p_partkey", K.package_link(F.lit("NPM"), name, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).alias("link"), K.decoded_segment(K.encoded_segment(name)).alias("name"))


@query(r"""SELECT doc_id, w = '' OR regexp_matches(w, '^[A-Za-z0-9+/=]{16,}$') OR regexp_matches(w, '^[0-9a-fA-F]{8,}$') OR NOT regexp_matches(w, '^[\x20-\x7e]*$') OR regexp_matches(w, '^[^a-zA-Z]*$') AS encoded FROM (SELECT doc_id, split_part(text, ' ', 2) AS w FROM documents)""")
def encoded_literals(documents):
    return documents.select("doc_id", K.looks_encoded(F.split_part("text", F.lit(" "), F.lit(2))).alias("encoded"))


@query("SELECT o_custkey AS key, CASE WHEN bool_or(o_orderstatus = 'P') THEN 0 ELSE 100 + count(*) END AS value FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 100 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def counter_increment(orders, customer):
    counters = customer.select(F.col("c_custkey").alias("key"), F.lit(100).cast("long").alias("value"))
    deltas = orders.select(F.col("o_custkey").alias("key"), F.lit(1).alias("delta"), (F.col("o_orderstatus") == "P").alias("reset"))
    return D.increment(counters, deltas, ["key"], "value")


@query("SELECT DISTINCT package_id FROM package WHERE package_id % 2 = 0 AND package_id NOT IN (SELECT package_id FROM analysis WHERE status IN ('QUEUED', 'RUNNING'))")
def enqueue_once(package, analysis):
    """Packages to analyse that aren't waiting or running already."""
    return D.enqueue(analysis, package.where("package_id % 2 = 0"), ["package_id"], ["QUEUED", "RUNNING"])


@query("SELECT analysis_id, status FROM analysis WHERE status IN ('QUEUED', 'FAILED', 'PARTIAL')")
def rerunnable(analysis):
    return D.rerunnable(analysis).select("analysis_id", "status")


@query("SELECT source AS package, doc_id, CAST(n AS BIGINT) AS position FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS n FROM documents) WHERE n <= 15")
def largest_files(documents):
    files = documents.select(F.col("source").alias("package"), F.length("text").alias("size"), F.col("doc_id").alias("path"))
    return V.largest(files, 15).select("package", F.col("path").alias("doc_id"), F.col("position").cast("long").alias("position"))


_WORST = ", ".join(f"'{s}'" for s in reversed(SEVERITIES))


@query(f"""WITH h AS (SELECT analysis_id AS file, line_start AS s, greatest(line_start, CASE WHEN line % 3 = 0 THEN NULL ELSE line_end END, line_start) AS e, list_position([{_WORST}], severity) AS rank, line * 1000 + file_path AS position FROM hit),
  l AS (SELECT file, unnest(range(s, e + 1)) AS line, rank, position FROM h) SELECT file, CAST(count(*) AS BIGINT) AS lines, CAST(sum(rank) AS BIGINT) AS ranks FROM (SELECT file, line, max(rank) AS rank FROM l GROUP BY 1, 2) GROUP BY 1""")
def line_severities(hit):
    """How many lines each report has marked, and the sum of their ranks."""
    rows = hit.select(
        F.col("analysis_id").alias("file"), F.col("line_start").alias("start"), F.when(F.col("line") % 3 != 0, F.col("line_end")).alias("end"), "severity", F.col("rule_id").alias("label"), (F.col("line") * 1000 + F.col("file_path")).alias("position")
    )
    runs = V.severity_runs(rows, list(reversed(SEVERITIES)))
    size = F.col("last") - F.col("first") + 1
    return runs.groupBy("file").agg(F.sum(size).alias("lines"), F.sum(size * F.col("rank")).alias("ranks"))


@query(f"""WITH r AS (SELECT DISTINCT parent AS node FROM edge WHERE parent NOT IN (SELECT child FROM edge)), c AS (SELECT DISTINCT child AS node FROM edge),
  n AS (SELECT node, 0 AS depth FROM r UNION ALL SELECT node, CASE WHEN node < 200000 THEN 1 WHEN node < 300000 THEN 2 ELSE 3 END FROM c), told AS (SELECT node, depth, CASE WHEN node % 6 < 5 THEN ({NAMES})[1 + node % 6] END AS verdict FROM n),
  p AS (SELECT node, depth FROM told WHERE verdict IS NULL) SELECT node, CAST(depth AS BIGINT) AS depth, greatest((SELECT count(*) FROM p) - 50, 0) AS remaining FROM p ORDER BY depth, lpad(CAST(node AS VARCHAR), 8, '0') LIMIT 50""")
def pending_by_depth(edge):
    """Nodes that await their analysis, nearest first."""
    edge = materialise(edge, "edges")  # every round reads it
    tree = G.depths(edge, G.roots(edge))
    verdict = F.when(F.col("node") % 6 < 5, F.element_at(F.array(*map(F.lit, VERDICTS)), (F.col("node") % 6 + 1).cast("int")))
    rows = tree.select("node", F.col("depth").cast("long").alias("depth"), verdict.alias("verdict"), F.lpad(F.col("node").cast("string"), 8, "0").alias("name"))
    return G.pending(rows, 50).select("node", "depth", "remaining")


@query("""WITH c AS (SELECT c_custkey AS node, c_nationkey AS k, c_acctbal AS b FROM customer), n AS (SELECT node, CASE WHEN node % 5 = 0 THEN NULL WHEN node % 5 = 1 THEN node + 1000000 ELSE node - 1 END AS parent FROM c)
  SELECT node, CASE WHEN parent IN (SELECT node FROM n) THEN parent END AS parent, parent IS NULL OR parent NOT IN (SELECT node FROM n) AS is_root FROM n""")
def tree_from_paths(customer):
    """A stored tree from its paths: orphans, whose parent is gone, become roots."""
    k = F.col("c_custkey")
    path = F.when(k % 5 == 0, F.array().cast("array<bigint>")).when(k % 5 == 1, F.array(k + 1_000_000)).otherwise(F.array(F.lit(0).cast("long"), k - 1))
    return G.from_paths(customer.select(k.alias("node"), path.alias("path")))


@query("SELECT analysis_id, file_path, flagged FROM (SELECT analysis_id, file_path, count(*) AS flagged, sum(weight * confidence * modifier) AS risk FROM hit GROUP BY 1, 2) ORDER BY floor(risk * 100 + 0.5) / 100 DESC, file_path, analysis_id LIMIT 100")
def riskiest_files(hit):
    """The files of greatest risk first, equal ones by path."""
    sums = hit.groupBy("analysis_id", "file_path").agg(F.count("*").alias("flagged"), F.sum(F.col("weight") * F.col("confidence") * F.col("modifier")).alias("risk"))
    return sums.orderBy(F.desc(scoring.half_up(F.col("risk"), 2)), "file_path", "analysis_id").limit(100).select("analysis_id", "file_path", "flagged")
