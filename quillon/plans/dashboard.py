"""Dashboard, lists, feed and search."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions.core import FAMILIES, dense, first_per, page, top_per
from quillon.operators import relational as R
from quillon.plans.registry import query

AS_OF = "2001-07-31"
FLAGGED = "verdict IN ('KNOWN_MALICIOUS', 'LIKELY_MALICIOUS', 'SUSPICIOUS')"
RANK = "CASE verdict WHEN 'KNOWN_MALICIOUS' THEN 0 WHEN 'LIKELY_MALICIOUS' THEN 1 WHEN 'SUSPICIOUS' THEN 2 WHEN 'LOW_RISK' THEN 3 WHEN 'CLEAN' THEN 4 END"
NAMES = "['KNOWN_MALICIOUS', 'LIKELY_MALICIOUS', 'SUSPICIOUS', 'LOW_RISK', 'CLEAN']"


@query(f"""SELECT count(*) AS analyses, count(completed_at) AS completed, count_if(status = 'QUEUED')::BIGINT AS queued, count_if(status = 'PARTIAL')::BIGINT AS partial, count_if(completed_at IS NOT NULL AND {FLAGGED})::BIGINT AS flagged,
  count(DISTINCT package_id) AS packages, count(DISTINCT CASE WHEN {FLAGGED} THEN package_id END) AS flagged_packages, CAST(floor(avg(CASE WHEN completed_at IS NOT NULL THEN duration_ms END) + 0.5) AS BIGINT) AS mean_ms,
  CAST(quantile_disc(CASE WHEN completed_at IS NOT NULL THEN duration_ms END, 0.95) AS BIGINT) AS p95_ms FROM analysis""")
def dashboard_kpis(analysis):
    return R.kpis(analysis)


@query(f"""WITH n AS (SELECT verdict, count(*) AS n FROM analysis WHERE completed_at IS NOT NULL GROUP BY 1), names AS (SELECT unnest({NAMES}) AS verdict, CAST(generate_subscripts({NAMES}, 1) - 1 AS INT) AS rank),
  f AS (SELECT verdict, rank, coalesce(n, 0) AS n FROM names LEFT JOIN n USING (verdict))
  SELECT verdict, rank, n, floor(100 * n / greatest(sum(n) OVER (), 1) * 10 + 0.5) / 10 AS share, floor(n / greatest(max(n) OVER (), 1) * 1000 + 0.5) / 1000 AS bar FROM f""")
def verdict_distribution(analysis):
    return R.verdict_distribution(analysis)


@query(f"SELECT f.family, coalesce(n, 0) AS hits, coalesce(a, 0) AS analyses FROM (SELECT unnest({FAMILIES}) AS family) f LEFT JOIN (SELECT family, count(*) AS n, count(DISTINCT analysis_id) AS a FROM hit GROUP BY 1) USING (family)")
def family_totals(spark, hit):
    names = spark.createDataFrame([(f,) for f in FAMILIES], "family string")
    return dense(names, hit.groupBy("family").agg(F.count("*").alias("hits"), F.countDistinct("analysis_id").alias("analyses")), ["family"], {"hits": 0, "analyses": 0})


@query(f"""WITH days AS (SELECT CAST(unnest(range(DATE '{AS_OF}' - INTERVAL 13 DAY, DATE '{AS_OF}' + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT strftime(d.day, '%Y-%m-%d') AS day, count(analysis_id) AS completed, CAST(count_if(coalesce({FLAGGED}, false)) AS BIGINT) AS flagged FROM days d LEFT JOIN analysis a ON CAST(completed_at AS DATE) = d.day GROUP BY d.day""")
def daily_throughput_zero_filled(analysis):
    return R.throughput(analysis, AS_OF)


@query("SELECT analysis_id, package_id, name, ecosystem, status, verdict, completed_at FROM analysis JOIN package USING (package_id) ORDER BY completed_at DESC NULLS FIRST, analysis_id DESC LIMIT 20")
def recent_analyses_topk(analysis, package):
    top = analysis.drop("org_id").orderBy(*R.newest()).limit(20)
    return top.join(package, "package_id").select("analysis_id", "package_id", "name", "ecosystem", "status", "verdict", "completed_at")


@query(f"""WITH m AS (SELECT * FROM analysis WHERE org_id = 3 AND {FLAGGED} AND status <> 'QUEUED') SELECT analysis_id, package_id, verdict, completed_at, (SELECT count(*) FROM m) AS total FROM m
  ORDER BY completed_at DESC NULLS FIRST, analysis_id DESC LIMIT 5 OFFSET 5""")
def list_analyses_page(analysis):
    """The second page of a tenant's flagged analyses, with the number of all."""
    own = R.scoped(analysis, 3).where(F.col("verdict").isin(R.FLAGGED) & (F.col("status") != "QUEUED"))
    rows = page(own.select("analysis_id", "package_id", "verdict", "completed_at"), 2, 5, *R.newest())
    return rows.crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))  # one row


@query("SELECT package_id, name, ecosystem FROM package p WHERE EXISTS (SELECT 1 FROM analysis a JOIN hit h USING (analysis_id) WHERE a.package_id = p.package_id AND h.family = 'TYPOSQUAT')")
def list_packages_by_family(package, analysis, hit):
    return R.with_any(package, analysis, hit, "TYPOSQUAT").select("package_id", "name", "ecosystem")


@query(f"SELECT package_id, name, license FROM package p WHERE contains(lower(name), '00001') AND EXISTS (SELECT 1 FROM analysis a WHERE a.package_id = p.package_id AND {FLAGGED})")
def list_packages_semi(package, analysis):
    return package.where(F.contains(F.lower("name"), F.lit("00001"))).join(analysis.where(F.col("verdict").isin(R.FLAGGED)), "package_id", "left_semi").select("package_id", "name", "license")


@query(f"""WITH last AS (SELECT * FROM analysis QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY completed_at DESC NULLS FIRST, analysis_id DESC) = 1),
  sums AS (SELECT package_id, count(*) AS versions, min({RANK}) AS worst FROM analysis GROUP BY 1)
  SELECT p.package_id, name, ecosystem, coalesce(versions, 0) AS versions, analysis_id AS latest_id, status AS latest_status, verdict AS latest_verdict, ({NAMES})[1 + worst] AS worst_verdict
  FROM package p LEFT JOIN sums USING (package_id) LEFT JOIN last USING (package_id)""")
def package_overview_latest(package, analysis):
    return R.overview(package, analysis)


@query("SELECT package_id, analysis_id, verdict, created_at, CAST(n AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY created_at DESC, analysis_id DESC) AS n FROM analysis) WHERE n <= 5")
def sibling_versions(analysis):
    return top_per(analysis, ["package_id"], 5, F.desc("created_at"), F.desc("analysis_id")).select("package_id", "analysis_id", "verdict", "created_at", F.col("position").cast("long").alias("position"))


@query("""WITH pairs AS (SELECT * FROM (SELECT package_id, analysis_id, lag(analysis_id) OVER (PARTITION BY package_id ORDER BY completed_at, analysis_id) AS previous_id FROM analysis WHERE completed_at IS NOT NULL) WHERE previous_id IS NOT NULL),
  r AS (SELECT DISTINCT analysis_id, rule_id FROM hit)
  SELECT package_id, analysis_id, previous_id,
    coalesce((SELECT string_agg(rule_id, ',' ORDER BY rule_id) FROM r WHERE r.analysis_id = p.analysis_id AND NOT EXISTS (SELECT 1 FROM r o WHERE o.analysis_id = p.previous_id AND o.rule_id = r.rule_id)), '') AS new_rules,
    coalesce((SELECT string_agg(rule_id, ',' ORDER BY rule_id) FROM r WHERE r.analysis_id = p.previous_id AND NOT EXISTS (SELECT 1 FROM r o WHERE o.analysis_id = p.analysis_id AND o.rule_id = r.rule_id)), '') AS resolved_rules FROM pairs p""")
def compare_versions_new_resolved(analysis, hit):
    return R.compare_runs(analysis, hit)


@query("SELECT analysis_id, package_id, lag(analysis_id) OVER w AS previous_id, lag(created_at) OVER w AS previous_at FROM analysis WHERE status <> 'QUEUED' WINDOW w AS (PARTITION BY package_id ORDER BY created_at, analysis_id)")
def previous_analysed_version(analysis):
    w = Window.partitionBy("package_id").orderBy("created_at", "analysis_id")
    return analysis.where("status <> 'QUEUED'").select("analysis_id", "package_id", F.lag("analysis_id").over(w).alias("previous_id"), F.lag("created_at").over(w).alias("previous_at"))


@query(f"""WITH rows AS (SELECT *, {RANK} AS rank FROM analysis WHERE {FLAGGED} AND completed_at IS NOT NULL),
  first AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY rank, completed_at DESC, analysis_id DESC) = 1),
  times AS (SELECT package_id, max(completed_at) AS flagged_at, count(*) AS sightings FROM rows GROUP BY 1)
  SELECT package_id, name, ecosystem, verdict, flagged_at, sightings, analysis_id FROM first JOIN times USING (package_id) JOIN package USING (package_id) ORDER BY rank, flagged_at DESC, package_id LIMIT 50""")
def intel_feed(analysis, package):
    return R.feed(analysis, package, 50)


@query(f"""WITH rows AS (SELECT *, {RANK} AS rank FROM analysis WHERE {FLAGGED} AND completed_at IS NOT NULL),
  page AS (SELECT package_id, min(rank) AS rank, max(completed_at) AS flagged_at FROM rows GROUP BY 1 ORDER BY rank, flagged_at DESC, package_id LIMIT 50),
  own AS (SELECT package_id, analysis_id FROM analysis WHERE org_id = 3 AND verdict IS NOT NULL QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY completed_at DESC NULLS LAST, analysis_id DESC) = 1)
  SELECT package_id, flagged_at, own.analysis_id AS own_analysis_id FROM page LEFT JOIN own USING (package_id)""")
def intel_feed_owned(analysis, package):
    """A page of the feed over all tenants, each package with the reader's own latest analysis of it, if there is one."""
    return R.owned(R.feed(analysis, package, 50), analysis.where("org_id = 3")).select("package_id", "flagged_at", "own_analysis_id")


@query("SELECT org_id, packages, coalesce(analyses, 0) AS analyses, coalesce(queued, 0) AS queued FROM (SELECT org_id, count(*) AS packages FROM package GROUP BY 1) LEFT JOIN (SELECT org_id, count(*) AS analyses, CAST(count_if(status = 'QUEUED') AS BIGINT) AS queued FROM analysis GROUP BY 1) USING (org_id)")
def org_usage(package, analysis):
    own = package.groupBy("org_id").agg(F.count("*").alias("packages"))
    runs = analysis.groupBy("org_id").agg(F.count("*").alias("analyses"), F.count_if(F.col("status") == "QUEUED").alias("queued"))
    return own.join(runs, "org_id", "left").fillna(0, ["analyses", "queued"])


@query(f"SELECT ecosystem, CAST(count_if({FLAGGED}) AS BIGINT) AS malicious, CAST(count_if(NOT {FLAGGED}) AS BIGINT) AS clean, count(*) AS total FROM analysis JOIN package USING (package_id) GROUP BY 1")
def verdicts_by_ecosystem(analysis, package):
    flagged = F.col("verdict").isin(R.FLAGGED)
    joined = analysis.drop("org_id").join(package, "package_id")
    return joined.groupBy("ecosystem").agg(F.count_if(flagged).alias("malicious"), F.count_if(~flagged).alias("clean"), F.count("*").alias("total"))


@query("""SELECT * FROM (SELECT 'customer' AS kind, c_custkey AS id, c_name AS text FROM customer WHERE contains(lower(c_name), '07') ORDER BY c_name, c_custkey LIMIT 8) UNION ALL
  SELECT * FROM (SELECT 'part', p_partkey, p_name FROM part WHERE contains(lower(p_name), '07') ORDER BY p_name, p_partkey LIMIT 8) UNION ALL
  SELECT * FROM (SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '07') ORDER BY s_name, s_suppkey LIMIT 8)""")
def search_union(customer, part, supplier):
    return R.searched("07", 8, customer=(customer, "c_custkey", "c_name"), part=(part, "p_partkey", "p_name"), supplier=(supplier, "s_suppkey", "s_name"))


@query("""SELECT a.analysis_id, p.package_id, p.name, CASE WHEN a.created_at < TIMESTAMP '2001-07-01' THEN true ELSE false END AS stalled FROM analysis a JOIN package p USING (package_id) WHERE a.status = 'QUEUED' ORDER BY a.created_at, a.analysis_id LIMIT 25""")
def job_queue(analysis, package):
    """Oldest queued runs first, with those that have waited too long marked."""
    top = analysis.drop("org_id").where("status = 'QUEUED'").orderBy("created_at", "analysis_id").limit(25)
    return top.join(package, "package_id").select("analysis_id", "package_id", "name", (F.col("created_at") < F.lit("2001-07-01").cast("timestamp_ntz")).alias("stalled"))


@query("SELECT package_id, analysis_id, verdict FROM analysis QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY created_at DESC, analysis_id DESC) = 1")
def latest_per_package(analysis):
    return first_per(analysis, ["package_id"], F.desc("created_at"), F.desc("analysis_id")).select("package_id", "analysis_id", "verdict")
