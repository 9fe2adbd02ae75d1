"""Evaluation of verdicts against a labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.core import VERDICTS, half_up, rank_of


def observed(corpus: DataFrame, verdicts: DataFrame, threshold: str) -> DataFrame:
    """Each corpus entry with its verdict and outcome; one without a verdict is UNCOVERED, neither right nor wrong."""
    flagged = rank_of(F.col("verdict"), VERDICTS) <= VERDICTS.index(threshold)
    bad = F.col("label") == "MALICIOUS"
    outcome = F.when(F.col("verdict").isNull(), "UNCOVERED").when(bad & flagged, "TP").when(bad, "FN").when(flagged, "FP").otherwise("TN")
    return corpus.join(verdicts, "entry_id", "left").withColumn("outcome", outcome)


def matrix(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("TP", "FP", "TN", "FN", "UNCOVERED")))


def ratio(part: Column, whole: Column) -> Column:
    """Zero where the whole is; three digits."""
    return half_up(F.when(whole > 0, part / whole).otherwise(0.0), 3)


def metrics(m: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return m.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn)})


def summary(rows: DataFrame) -> DataFrame:
    """Entries of each label: how many there are, have a verdict, have none, and have a hash."""
    return rows.groupBy("label").agg(F.count("*").alias("entries"), F.count("verdict").alias("covered"), (F.count("*") - F.count("verdict")).alias("uncovered"), F.count("hash").alias("with_hash"))


def contribution(rows: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """For each family or rule: malicious and clean entries it fired on, once an entry, and its precision."""
    once = rows.where("verdict is not null").select("entry_id", "label", "analysis_id").join(hits.select("analysis_id", key).distinct(), "analysis_id")
    sums = once.groupBy(key).agg(F.countDistinct(F.when(F.col("label") == "MALICIOUS", F.col("entry_id"))).alias("on_malicious"), F.countDistinct(F.when(F.col("label") != "MALICIOUS", F.col("entry_id"))).alias("on_clean"))
    return sums.withColumn("precision", ratio(F.col("on_malicious"), F.col("on_malicious") + F.col("on_clean")))
