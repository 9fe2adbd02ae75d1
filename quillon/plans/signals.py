"""Queries about signals of names, maintainers and sources, verdicts with all their parts, and indicators."""

from pyspark.sql import functions as F

from quillon.functions import coordinates as K
from quillon.functions.core import FAMILIES, VERDICTS
from quillon.operators import campaigns as C
from quillon.operators import governance as V
from quillon.operators import intervals, scoring, sensitivity
from quillon.operators import provenance as P
from quillon.operators import signals as S
from quillon.operators import typosquat as T
from quillon.plans.dashboard import NAMES
from quillon.plans.files import TREES, trees
from quillon.plans.registry import SQL, query
from quillon.plans.scoring import _TRIGGERS, FIRED, POINTS
from quillon.plans.typosquat import CANON, NEAR, candidates, popular

ACCOUNTS = """m AS (SELECT o_custkey AS package, o_orderkey % 13 AS name, CASE WHEN any_value(o_orderkey % 13) % 4 <> 0 THEN min(o_orderdate) - INTERVAL 40 DAY END AS created_at,
    CASE WHEN any_value(o_orderkey % 13) % 3 <> 0 THEN any_value(o_orderkey % 13) END AS packages FROM orders GROUP BY 1, 2),
  p AS (SELECT package_id AS package, max(published_at) AS published_at, CASE WHEN package_id % 7 <> 0 THEN any_value(downloads) * 20 END AS downloads FROM release JOIN package USING (package_id) GROUP BY package_id),
  f AS (SELECT p.package, p.downloads, m.name, created_at, packages, coalesce(epoch_us(published_at) - epoch_us(created_at) <= 90 * 86400000000, false) OR coalesce(packages <= 3, false) AS odd FROM p LEFT JOIN m USING (package)),
  s AS (SELECT package, any_value(downloads) AS downloads, count(name) AS n, count_if(created_at IS NOT NULL OR packages IS NOT NULL) AS known, count_if(odd) AS odd, min(CASE WHEN odd THEN CAST(name AS VARCHAR) END) AS who FROM f GROUP BY 1)"""


@query(f"""WITH {ACCOUNTS} SELECT package, 'Q-MNT-003' AS rule_id, CASE WHEN known > 0 THEN 0.7::DOUBLE END AS confidence, CASE WHEN known = 0 THEN 'NO_METADATA' END AS skipped, CASE WHEN known > 0 THEN who END AS detail FROM s WHERE known = 0 OR odd > 0
  UNION ALL SELECT package, 'Q-MNT-004', CASE WHEN downloads IS NOT NULL THEN 0.6::DOUBLE END, CASE WHEN downloads IS NULL THEN 'NO_DOWNLOAD_DATA' END, NULL FROM s WHERE downloads IS NULL OR (n = 1 AND downloads >= 100000)""")
def maintainer_account_signals(orders, release, package):
    actor = F.col("o_orderkey") % 13
    accounts = orders.groupBy(F.col("o_custkey").alias("package"), actor.alias("name")).agg(F.min("o_orderdate").alias("first"))
    accounts = accounts.select("package", "name", F.when(F.col("name") % 4 != 0, F.col("first") - F.expr("INTERVAL 40 DAYS")).alias("created_at"), F.when(F.col("name") % 3 != 0, F.col("name")).alias("packages"))
    own = release.join(package, "package_id").groupBy(F.col("package_id").alias("package")).agg(F.max("published_at").alias("published_at"), F.max(F.col("downloads") * 20).alias("d"))
    return S.account_signals(own.select("package", "published_at", F.when(F.col("package") % 7 != 0, F.col("d")).alias("downloads")), accounts)


SOURCES = f"""{TREES}, o AS (SELECT DISTINCT source AS package, CAST(substring(source, 4) AS INT) AS k FROM documents),
  n AS (SELECT package, count_if(status = 'ONLY_PACKAGED') AS extra, count_if(status = 'MODIFIED') AS modified, count_if(status = 'IDENTICAL') AS same, count_if(status = 'ONLY_PACKAGED' AND regexp_matches(path, '\\.(js|py)$')) AS executable FROM t GROUP BY 1),
  j AS (SELECT o.package, k, coalesce(extra, 0) AS extra, coalesce(modified, 0) AS modified, coalesce(same, 0) AS same, coalesce(executable, 0) AS executable, k % 7 = 0 AS no_repo, k % 7 = 1 AS unread, k % 7 = 2 AS archived, k % 3 = 0 AS attested, k % 4 = 0 AS builds FROM o LEFT JOIN n USING (package)),
  c AS (SELECT *, modified + same AS compared, builds OR (modified + same > 0 AND executable > 5 AND executable / greatest(executable + modified + same, 1) > 0.5) AS built, CASE WHEN no_repo THEN 'NO_REPO' WHEN unread THEN 'REPO_UNREACHABLE' END AS why FROM j),
  told AS (
    SELECT package, 'Q-PRV-001' AS rule_id, 0.95 AS confidence, NULL AS skipped FROM c WHERE no_repo
    UNION ALL SELECT package, 'Q-PRV-002', CASE WHEN no_repo THEN NULL WHEN unread THEN 0.75 ELSE 0.6 END, CASE WHEN no_repo THEN 'NO_REPO' END FROM c WHERE no_repo OR unread OR archived
    UNION ALL SELECT package, 'Q-PRV-003', CASE WHEN why IS NOT NULL OR (executable > 0 AND built) THEN NULL WHEN executable > 0 THEN 0.95 ELSE 0.6 END, CASE WHEN why IS NOT NULL THEN why WHEN executable > 0 AND built THEN 'BUILD_OUTPUT' END FROM c WHERE why IS NOT NULL OR executable > 0 OR extra > 2
    UNION ALL SELECT package, 'Q-PRV-004', CASE WHEN why IS NOT NULL OR compared = 0 THEN NULL WHEN modified / compared > 0.5 THEN 0.85 ELSE 0.65 END, CASE WHEN why IS NOT NULL THEN why WHEN compared = 0 THEN 'NO_TAG_MATCH' END FROM c WHERE why IS NOT NULL OR compared = 0 OR modified / compared > 0.15
    UNION ALL SELECT package, 'Q-PRV-006', 0.9, NULL FROM c WHERE NOT attested)"""


def sources(documents):
    k = F.substring("source", 4, 10).cast("int")
    own = documents.select(F.col("source").alias("package"), k.alias("k")).distinct()
    k = F.col("k")
    repos = own.select("package", F.when(k % 7 != 0, "https://code.example/a/b").alias("repository_url"), (k % 7 != 1).alias("readable"), (k % 7 == 2).alias("archived"), (k % 3 == 0).alias("attested"))
    manifests = own.where(k % 4 == 0).select("package", F.lit("tsconfig.json").alias("path"))
    return S.source_signals(repos, trees(documents), P.builds(manifests), own.limit(0))


@query(f"WITH {SOURCES} SELECT package, rule_id, CAST(confidence AS DOUBLE) AS confidence, skipped FROM told")
def provenance_signals(documents):
    return sources(documents).drop("detail")


@query(f"""WITH {SOURCES}, p AS (SELECT package, max(CASE WHEN rule_id = 'Q-PRV-003' THEN confidence END) AS c3, max(CASE WHEN rule_id = 'Q-PRV-004' THEN confidence END) AS c4, max(CASE WHEN rule_id = 'Q-PRV-004' THEN skipped END) AS s4 FROM told GROUP BY 1)
  SELECT package, CASE WHEN s4 IN ('NO_REPO', 'REPO_UNREACHABLE') THEN s4 WHEN c3 IS NOT NULL OR c4 IS NOT NULL THEN 'DIVERGENT' WHEN s4 = 'NO_TAG_MATCH' THEN 'NO_TAG' ELSE 'MATCH' END AS status FROM p""")
def provenance_states(documents):
    return S.source_status(sources(documents))


SCOPED = """scoped AS (SELECT DISTINCT concat('@', lower(replace(p_brand, '#', '')), '/', replace(p_name, ' ', '-')) AS name, CAST(sum(p_size) AS BIGINT) AS downloads FROM part GROUP BY p_brand, p_name),
  tries AS (SELECT concat(lower(replace(p_brand, '#', '')), '-', replace(p_name, ' ', '-')) AS name FROM part UNION SELECT concat('@', lower(replace(p_brand, '#', '-')), 'x/', replace(p_name, ' ', '')) FROM part UNION SELECT name FROM scoped)"""
_SCOPE, _BARE = "regexp_extract({0}, '^@([^/]+)/', 1)", "regexp_replace({0}, '^@[^/]+/', '')"


def _canon(x: str) -> str:
    return CANON.format(x)


@query(f"""WITH {SCOPED}, t AS (SELECT name AS target, downloads, {_SCOPE.format('name')} AS ts, {_BARE.format('name')} AS tb FROM scoped), c AS (SELECT name, {_SCOPE.format('name')} AS s, {_BARE.format('name')} AS b FROM tries),
  j AS (SELECT name, target, downloads, 'scope flattened into the name' AS technique FROM c JOIN t ON s = '' AND {_canon('name')} = {_canon('concat(ts, tb)')}
    UNION ALL SELECT name, target, downloads, 'scope impersonated' FROM c JOIN t ON s <> '' AND s <> ts AND {_canon('b')} = {_canon('tb')} AND damerau_levenshtein({_canon('s')}, {_canon('ts')}) <= 2)
  SELECT name, target, technique FROM j QUALIFY row_number() OVER (PARTITION BY name ORDER BY downloads DESC, target) = 1""")
def scope_confusion(part):
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    dashed = F.replace("p_name", F.lit(" "), F.lit("-"))
    name = F.concat(F.lit("@"), brand, F.lit("/"), dashed)
    known = part.groupBy(name.alias("name")).agg(F.sum("p_size").alias("downloads"))
    made = F.array(F.concat(brand, F.lit("-"), dashed), F.concat(F.lit("@"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("x/"), F.replace("p_name", F.lit(" "), F.lit(""))), name)
    return S.scope_confusion(part.select(F.explode(made).alias("name")).distinct(), known)


@query(r"""WITH n AS (SELECT c_custkey AS package, CASE c_custkey % 6 WHEN 0 THEN concat('@internal-', c_custkey, '/x') WHEN 1 THEN concat('corp-', c_custkey) WHEN 2 THEN concat('@Acme/', c_custkey) ELSE c_name END AS name,
    CASE WHEN c_custkey % 5 = 0 THEN 'Do not use outside, please' WHEN c_custkey % 7 = 0 THEN 'privately kept' ELSE c_mktsegment END AS description FROM customer)
  SELECT package, CASE WHEN regexp_matches(regexp_extract(name, '^@([^/]+)/', 1), '(?i)^(?:internal|private|corp|company|acme|test|dev|staging|local)') THEN 'scope: ' || regexp_extract(name, '^@([^/]+)/', 1)
    WHEN regexp_matches(name, '(?i)^(?:internal|private|corp|company)[-_.]') THEN 'prefix' WHEN regexp_matches(description, '(?i)\b(?:internal|private|do not (?:use|publish)|company[- ]only)\b') THEN 'description' END AS posture FROM n""")
def confusion_posture(customer):
    k, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    name = F.when(k % 6 == 0, F.concat(F.lit("@internal-"), text, F.lit("/x"))).when(k % 6 == 1, F.concat(F.lit("corp-"), text)).when(k % 6 == 2, F.concat(F.lit("@Acme/"), text)).otherwise(F.col("c_name"))
    description = F.when(k % 5 == 0, "Do not use outside, please").when(k % 7 == 0, "privately kept").otherwise(F.col("c_mktsegment"))
    return customer.select(k.alias("package"), S.posture(name, description).alias("posture"))


@query(f"""WITH {NEAR}, n AS (SELECT name, target, min(distance) AS distance FROM near GROUP BY 1, 2) SELECT target AS package, name AS resembles_it, CAST(distance AS INT) AS distance,
  CASE WHEN distance = 0 THEN 1.0::DOUBLE ELSE greatest(0.0, 1 - distance / length(target)) END AS similarity FROM n""")
def resembling_me(part):
    """Who resembles a popular name, the closest match of each pair once."""
    near = T.neighbours(candidates(part), popular(part)).groupBy("name", "target").agg(F.min("distance").cast("int").alias("distance"))
    return near.select(F.col("target").alias("package"), F.col("name").alias("resembles_it"), "distance", K.similarity(F.col("distance"), F.col("target")).alias("similarity"))


COMPLETE = f"""sums AS (SELECT analysis_id, {POINTS} AS total, avg(confidence) AS mean, count(DISTINCT h.family) AS families, count(*) AS n, list(h.rule_id) AS fired FROM {FIRED} h LEFT JOIN rule USING (rule_id) GROUP BY analysis_id),
  bad AS (SELECT analysis_id FROM analysis WHERE duration_ms % 97 = 0), failed AS (SELECT analysis_id, count(DISTINCT f) AS stages FROM (SELECT analysis_id, unnest(CASE WHEN duration_ms % 10 = 0 THEN ['TYPOSQUAT', 'PROVENANCE'] ELSE ['MAINTAINER'] END) AS f FROM analysis WHERE status = 'PARTIAL') GROUP BY 1),
  skips AS (SELECT analysis_id, count(*) AS skips FROM (SELECT analysis_id, r.rule_id FROM analysis JOIN rule r ON r.number = 1 + analysis_id % 5 EXCEPT SELECT analysis_id, rule_id FROM hit) GROUP BY 1),
  rows AS (SELECT a.analysis_id, a.org_id, coalesce(total, 0) AS total, mean, coalesce(families, 0) AS families, coalesce(n, 0) AS n, coalesce(fired, []) AS fired, b.analysis_id IS NOT NULL AS bad, 0.12 * coalesce(stages, 0) + 0.12 * coalesce(skips, 0) / 41 AS loss
    FROM analysis a LEFT JOIN sums USING (analysis_id) LEFT JOIN bad b USING (analysis_id) LEFT JOIN failed USING (analysis_id) LEFT JOIN skips USING (analysis_id)),
  told AS (SELECT *, {_TRIGGERS} AS triggers, CASE WHEN total >= 100 THEN 0 WHEN total >= 55 THEN 1 WHEN total >= 28 THEN 2 WHEN total >= 10 THEN 3 ELSE 4 END AS scored, CASE WHEN n = 0 THEN 0.9 ELSE mean + 0.08 * (families - 1) END - loss AS sure FROM rows)"""


@query(f"""WITH {COMPLETE} SELECT analysis_id, org_id, floor(total * 1e4 + 0.5) / 1e4 AS score, array_to_string(triggers, ',') AS triggers, CAST(n AS BIGINT) AS rules_fired,
  CASE WHEN bad THEN 1.0::DOUBLE ELSE floor(greatest(0.1, least(1.0, CAST(sure AS DOUBLE))) * 1e4 + 0.5) / 1e4 END AS confidence,
  ({NAMES})[1 + CASE WHEN bad THEN 0 WHEN len(triggers) > 0 THEN least(scored, 1) ELSE scored END] AS verdict, CASE WHEN bad THEN 'known-bad-hash' WHEN len(triggers) > 0 AND scored > 1 THEN 'hard-trigger' ELSE 'weighted-score' END AS decided_by FROM told""")
def verdict_scorecard_complete(analysis, hit, rule):
    """With known archives, rules that couldn't be judged, and families that weren't examined."""
    failed = analysis.where("status = 'PARTIAL'").select("analysis_id", F.explode(F.when(F.col("duration_ms") % 10 == 0, F.array(F.lit("TYPOSQUAT"), F.lit("PROVENANCE"))).otherwise(F.array(F.lit("MAINTAINER")))).alias("family"))
    skipped = analysis.select("analysis_id", (1 + F.col("analysis_id") % 5).alias("number")).join(F.broadcast(rule.select("rule_id", "number")), "number").select("analysis_id", "rule_id")
    return scoring.scorecard(analysis, hit, rule, analysis.where("duration_ms % 97 = 0"), skipped, failed)


_COUNTS = ", ".join(f"CAST(count(DISTINCT CASE WHEN family = '{f}' THEN rule_id END) AS BIGINT) AS {f.lower()}" for f in FAMILIES)


@query(f"SELECT analysis_id, {_COUNTS} FROM hit GROUP BY 1")
def signal_counts_all(hit):
    """Distinct fired rules of each of the six families."""
    return scoring.signal_counts(hit, FAMILIES)


@query(f"SELECT floor(score * 10) / 10 AS score, verdict, count(*) AS analyses FROM ({SQL['verdict_scorecard']}) s WHERE decided_by = 'weighted-score' GROUP BY 1, 2")
def verdict_boundaries(analysis, hit, rule):
    """The verdicts of all scores that occur, in steps of a tenth, to see where they turn; triggers aside."""
    rows = scoring.scorecard(analysis, hit, rule).where("decided_by = 'weighted-score'")
    return rows.groupBy((F.floor(F.col("score") * 10) / 10).alias("score"), "verdict").agg(F.count("*").alias("analyses"))


@query()
def verdict_sensitivity(analysis, hit, rule):
    """How few rules more or less would change each verdict; tests/test_sensitivity.py has a brute-force version."""
    return sensitivity.sensitivity(analysis, hit, rule)


@query("SELECT a.analysis_id, a.line_start, count(*) AS ranges FROM hit a JOIN hit b ON a.analysis_id = b.analysis_id AND a.line_start BETWEEN b.line_start AND b.line_end GROUP BY 1, 2")
def lines_in_ranges(hit):
    """How many findings each first line of a finding lies in."""
    points = hit.select("analysis_id", F.col("line_start").alias("at"))
    ranges = hit.select("analysis_id", "line_start", "line_end")
    return intervals.inside(points, ranges, ["analysis_id"], "at", "line_start", "line_end", 32).groupBy("analysis_id", F.col("at").alias("line_start")).agg(F.count("*").alias("ranges"))


@query("""WITH e AS (SELECT package_id, unnest([concat('Q-INS-00', 1 + package_id % 7), concat('Q-CAP-00', 1 + package_id % 9), concat('Q-CAP-00', 1 + package_id % 9)]) AS rule_id FROM package WHERE package_id % 4 = 0),
  n AS (SELECT rule_id, count(DISTINCT package_id) AS entries FROM e GROUP BY 1) SELECT r.rule_id, r.family, CAST(coalesce(entries, 0) AS BIGINT) AS entries FROM rule r LEFT JOIN n USING (rule_id)""")
def rule_expected_coverage(package, rule):
    """How many labelled packages expect each rule's signal."""
    k = F.col("package_id")
    ids = F.array(F.format_string("Q-INS-%03d", 1 + k % 7), F.format_string("Q-CAP-%03d", 1 + k % 9), F.format_string("Q-CAP-%03d", 1 + k % 9))
    entries = package.where(k % 4 == 0).select("package_id", F.explode(F.array_distinct(ids)).alias("rule_id")).groupBy("rule_id").agg(F.count("*").alias("entries"))
    return F.broadcast(rule).join(entries, "rule_id", "left").select("rule_id", "family", F.coalesce("entries", F.lit(0)).alias("entries"))


@query("""WITH h AS (SELECT DISTINCT v.variant, package_id FROM hit JOIN analysis USING (analysis_id) JOIN (VALUES ('any', 0.0), ('sure', 0.5), ('surest', 0.9)) v(variant, least) ON confidence >= least WHERE family = 'CAPABILITY'),
  l AS (SELECT package_id, bool_or(verdict IN ('KNOWN_MALICIOUS', 'LIKELY_MALICIOUS')) AS bad FROM analysis GROUP BY 1), b AS (SELECT count_if(bad) AS bad FROM l), t AS (SELECT variant, count_if(bad) AS tp, count_if(NOT bad) AS fp FROM h JOIN l USING (package_id) GROUP BY 1)
  SELECT variant, CAST(tp AS BIGINT) AS true_positives, CAST(fp AS BIGINT) AS false_positives, CAST(b.bad - tp AS BIGINT) AS missed, tp / (tp + fp) AS precision, CASE WHEN b.bad > 0 THEN tp / b.bad END AS recall FROM t, b""")
def rule_variant_quality(hit, analysis):
    """Precision and recall of three variants of a family's rules over the labelled packages."""
    variants = F.array(*(F.when(F.col("confidence") >= least, v) for v, least in (("any", 0.0), ("sure", 0.5), ("surest", 0.9))))
    own = hit.where("family = 'CAPABILITY'").select("analysis_id", F.explode(F.array_compact(variants)).alias("variant")).join(analysis.select("analysis_id", "package_id"), "analysis_id").select("variant", F.col("package_id").alias("package"))
    labels = analysis.groupBy(F.col("package_id").alias("package")).agg(F.bool_or(F.col("verdict").isin("KNOWN_MALICIOUS", "LIKELY_MALICIOUS")).alias("bad"))
    return V.variant_quality(own, labels)


_HOSTS = ", ".join(f"'{h}'" for h in C.INFRASTRUCTURE)


@query(rf"""WITH h AS (SELECT page_id % 40 AS member, CASE page_id % 4 WHEN 0 THEN 'Q-CAP-008' WHEN 1 THEN 'Q-CAP-009' WHEN 2 THEN 'Q-MNT-002' ELSE 'Q-CAP-007' END AS rule_id, page_id % 5 + 1 AS v, 0.5 + page_id % 5 / 10 AS confidence,
    concat('see ', url, ' or https://GitHub.com/x, pay 0xAB', substring(md5(CAST(page_id % 30 AS VARCHAR)), 1, 32), 'CDEF12 now') AS excerpt, CASE WHEN page_id % 3 = 0 THEN '8.8.4.4' END AS address, sha256(CAST(page_id % 20 AS VARCHAR)) AS sha256, concat('User', page_id % 9) AS maintainer FROM pages),
  g AS (SELECT * FROM h WHERE v <= 3),
  i AS (SELECT member, confidence, 'EXFIL_ENDPOINT' AS type, address AS value FROM g WHERE rule_id IN ('Q-CAP-007', 'Q-CAP-008') AND address IS NOT NULL
    UNION ALL SELECT member, confidence, 'EXFIL_ENDPOINT', lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) FROM (SELECT member, confidence, unnest(regexp_extract_all(excerpt, '(?i)\bhttps?://[^\s''"`)\\<>]+')) AS u FROM g WHERE rule_id IN ('Q-CAP-007', 'Q-CAP-008'))
    UNION ALL SELECT member, confidence, 'WALLET', lower(unnest(regexp_extract_all(excerpt, '\b0x[a-fA-F0-9]{{40}}\b'))) FROM g UNION ALL SELECT member, confidence, 'CODE_HASH', sha256 FROM g WHERE rule_id = 'Q-CAP-009' UNION ALL SELECT member, confidence, 'MAINTAINER', lower(maintainer) FROM g WHERE rule_id = 'Q-MNT-002')
  SELECT member, type, value, CAST(max(confidence) AS DOUBLE) AS confidence FROM i WHERE value <> '' AND value NOT IN ({_HOSTS}) GROUP BY 1, 2, 3""")
def campaign_indicators(pages):
    k, text = F.col("page_id"), lambda n: (F.col("page_id") % n).cast("string")
    rule = F.when(k % 4 == 0, "Q-CAP-008").when(k % 4 == 1, "Q-CAP-009").when(k % 4 == 2, "Q-MNT-002").otherwise("Q-CAP-007")
    excerpt = F.concat(F.lit("see "), "url", F.lit(" or https://GitHub.com/x, pay 0xAB"), F.substring(F.md5(text(30).cast("binary")), 1, 32), F.lit("CDEF12 now"))
    verdict = F.element_at(F.array(*map(F.lit, VERDICTS)), (k % 5 + 1).cast("int"))
    hits = pages.select(
        (k % 40).alias("member"), rule.alias("rule_id"), verdict.alias("verdict"), (0.5 + (k % 5) / 10).alias("confidence"), excerpt.alias("excerpt"), F.when(k % 3 == 0, "8.8.4.4").alias("address"),
        F.sha2(text(20).cast("binary"), 256).alias("sha256"), F.concat(F.lit("User"), text(9)).alias("maintainer"), F.lit(None).cast("timestamp").alias("seen"),
    )
    return C.indicators(hits).select("member", "type", "value", "confidence")
