"""Queries over the labelled corpus: labels, and the latest finished analysis of each entry. Three analyses in a row belong to one entry."""

from pyspark.sql import functions as F

from quillon.operators import evaluation as E
from quillon.operators.relational import latest
from quillon.plans.registry import query

BASE = """corpus AS (SELECT doc_id AS entry_id, CASE WHEN toxic = 1 THEN 'MALICIOUS' ELSE 'CLEAN' END AS label, quality = 1 AS popular, CASE WHEN doc_id % 4 > 0 THEN sha256(CAST(doc_id AS VARCHAR)) END AS hash FROM labels),
  verdicts AS (SELECT analysis_id // 3 AS entry_id, analysis_id, verdict FROM analysis WHERE completed_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY analysis_id // 3 ORDER BY completed_at DESC, analysis_id DESC) = 1),
  seen AS (SELECT c.*, v.analysis_id, v.verdict, CASE WHEN verdict IS NULL THEN 'UNCOVERED' WHEN verdict IN ('KNOWN_MALICIOUS', 'LIKELY_MALICIOUS', 'SUSPICIOUS') THEN CASE label WHEN 'MALICIOUS' THEN 'TP' ELSE 'FP' END
           WHEN label = 'MALICIOUS' THEN 'FN' ELSE 'TN' END AS outcome FROM corpus c LEFT JOIN verdicts v USING (entry_id))"""
COUNTS = ", ".join(f"CAST(count_if(outcome = '{o}') AS BIGINT) AS {o.lower()}" for o in ("TP", "FP", "TN", "FN", "UNCOVERED"))


def _ratio(a, b):
    return f"floor(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0.0 END * 1000 + 0.5) / 1000"


RATIOS = f"{_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, {_ratio('fp', 'fp + tn')} AS fpr"


def seen(labels, analysis):
    digest = F.when(F.col("doc_id") % 4 > 0, F.sha2(F.col("doc_id").cast("string").cast("binary"), 256))
    corpus = labels.select(F.col("doc_id").alias("entry_id"), digest.alias("hash"), F.when(F.col("toxic") == 1, "MALICIOUS").otherwise("CLEAN").alias("label"), (F.col("quality") == 1).alias("popular"))
    done = analysis.where("completed_at is not null").withColumn("entry_id", F.floor(F.col("analysis_id") / 3))
    verdicts = latest(done, ["entry_id"]).select("entry_id", "analysis_id", "verdict")
    return E.observed(corpus, verdicts, "SUSPICIOUS")


@query(f"WITH {BASE} SELECT entry_id, label, popular, analysis_id, verdict, outcome FROM seen")
def corpus_observed(labels, analysis):
    return seen(labels, analysis).drop("hash")


@query(f"WITH {BASE} SELECT {COUNTS} FROM seen")
def confusion_matrix(labels, analysis):
    return E.matrix(seen(labels, analysis))


@query(f"WITH {BASE}, m AS (SELECT {COUNTS} FROM seen) SELECT *, {RATIOS} FROM m")
def eval_metrics(labels, analysis):
    return E.metrics(E.matrix(seen(labels, analysis)))


@query(f"WITH {BASE}, m AS (SELECT popular, {COUNTS} FROM seen GROUP BY 1) SELECT popular, fp, tn, {_ratio('fp', 'fp + tn')} AS fpr FROM m")
def fpr_by_group(labels, analysis):
    return E.metrics(E.matrix(seen(labels, analysis), "popular")).select("popular", "fp", "tn", "fpr")


def _contribution(key):
    return f"""WITH {BASE}, s AS (SELECT {key}, count(DISTINCT CASE WHEN label = 'MALICIOUS' THEN entry_id END) AS on_malicious, count(DISTINCT CASE WHEN label <> 'MALICIOUS' THEN entry_id END) AS on_clean
      FROM seen JOIN hit USING (analysis_id) GROUP BY 1) SELECT *, {_ratio('on_malicious', 'on_malicious + on_clean')} AS precision FROM s"""


@query(_contribution("family"))
def family_contribution(labels, analysis, hit):
    return E.contribution(seen(labels, analysis), hit, "family")


@query(_contribution("rule_id"))
def rule_contribution(labels, analysis, hit):
    return E.contribution(seen(labels, analysis), hit, "rule_id")


@query(f"WITH {BASE} SELECT label, count(*) AS entries, count(verdict) AS covered, count(*) - count(verdict) AS uncovered, count(hash) AS with_hash FROM seen GROUP BY 1")
def corpus_summary(labels, analysis):
    return E.summary(seen(labels, analysis))
