"""Reports, progress and evidence as rows, and what a dependency tree leaves out."""

from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import governance as V
from quillon.operators import graph
from quillon.plans.registry import query

_STAGES = ["fetch", "unpack", "score"]


@query(f"""SELECT analysis_id, CAST(position AS INTEGER) AS position, CASE position WHEN 0 THEN concat('{{"type":"accepted","analysis_id":', analysis_id, '}}') WHEN {len(_STAGES) + 1} THEN concat('{{"type":"result","status":"', status, '","verdict":"', verdict, '"}}')
  ELSE concat('{{"type":"progress","stage":"', ({_STAGES!r})[position], '","elapsed_ms":', CAST(trunc(duration_ms * position / {len(_STAGES)}) AS BIGINT), '}}') END AS event FROM analysis, (SELECT unnest(range(0, {len(_STAGES) + 2})) AS position) WHERE completed_at IS NOT NULL""")
def progress_events(analysis):
    """What each run has reported, line by line."""
    return V.progress(analysis, _STAGES)


@query("""WITH l AS (SELECT analysis_id, verdict, row_number() OVER (ORDER BY completed_at DESC, analysis_id DESC) - 1 AS position FROM analysis WHERE completed_at IS NOT NULL QUALIFY position < 10)
  SELECT 'facts' AS section, 0 AS position, concat('{"title":"Week","analyses":', count(*), ',"completed":', count(completed_at), '}') AS payload FROM analysis UNION ALL SELECT 'latest', position, concat('{"analysis_id":', analysis_id, ',"verdict":"', verdict, '"}') FROM l""")
def report_snapshot(analysis):
    """A report frozen as rows: its facts and the table that it shows."""
    facts = analysis.agg(F.count("*").alias("analyses"), F.count("completed_at").alias("completed"))
    last = analysis.where("completed_at is not null").orderBy(F.desc("completed_at"), F.desc("analysis_id")).limit(10).select("analysis_id", "verdict")
    return V.snapshot("Week", facts, latest=last)


@query("""SELECT analysis_id, line, file_path, evidence FROM hit, LATERAL (SELECT unnest(CASE line % 3 WHEN 0 THEN [NULL] WHEN 1 THEN [concat(rule_id, ' a')] ELSE [concat(rule_id, ' a'), concat(rule_id, ' b')] END) AS evidence)""")
def evidence_pieces(hit):
    """One row for each piece of evidence, and a bare one for a finding without any."""
    pieces = F.when(F.col("line") % 3 == 1, F.array(F.concat("rule_id", F.lit(" a")))).when(F.col("line") % 3 == 2, F.array(F.concat("rule_id", F.lit(" a")), F.concat("rule_id", F.lit(" b"))))
    return V.evidence_rows(hit.select("analysis_id", "line", "file_path", pieces.alias("evidence")))


@query("""WITH t AS (SELECT DISTINCT l_suppkey AS node FROM lineitem WHERE l_partkey % 3 = 0), n AS (SELECT s_suppkey AS node FROM supplier)
  SELECT node, 2 AS depth, 7 AS parent FROM t UNION ALL SELECT node, 1, NULL FROM n WHERE node NOT IN (SELECT node FROM t)""")
def orphan_nodes(lineitem, supplier):
    """A tree and the nodes that no root reaches, which stand at its first level."""
    tree = lineitem.where("l_partkey % 3 = 0").select(F.col("l_suppkey").alias("node")).distinct()
    tree = tree.select("node", F.lit(2).alias("depth"), F.lit(7).cast("long").alias("parent"), F.array(F.lit(7).cast("long")).alias("path"))
    return graph.with_orphans(tree, supplier.select(F.col("s_suppkey").alias("node"))).select("node", "depth", "parent")


@query("SELECT c_custkey, substring(regexp_replace(digest, '[^a-fA-F0-9]', '', 'g'), 1, 12) AS short FROM (SELECT c_custkey, concat('sha256-', md5(c_name), '=') AS digest FROM customer)")
def short_digests(customer):
    """Digests as they are shown."""
    digest = F.concat(F.lit("sha256-"), F.md5(F.col("c_name").cast("binary")), F.lit("="))
    return customer.select("c_custkey", X.short_hash(digest).alias("short"))


@query("SELECT page_id, page_id % 4 < 3 AS matches FROM pages")
def verified_integrity(pages):
    """Bytes against the digest that a registry gives for them, in its four forms."""
    content, k = F.col("html").cast("binary"), F.col("page_id")
    coded = lambda digest: F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    expected = F.when(k % 4 == 0, F.concat(F.lit("sha512-"), coded(F.sha2(content, 512)))).when(k % 4 == 1, F.sha1(content)).when(k % 4 == 2, F.concat(F.lit("sha1-"), coded(F.sha1(content)))).otherwise(F.concat(F.lit("md5-"), coded(F.md5(content))))
    return pages.select("page_id", X.integrity(content, expected).alias("matches"))
