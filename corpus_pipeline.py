"""A corpus pipeline of five training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs``. Each stage's result is
written as Parquet to the shared folder and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, decontam, minhash, rff, toxicity
from quillon.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are judged as texts of zero statistics; repeated rows go
    or stay together; without labels, and in an empty table, nothing goes.
    """
    return rff.keep_good(docs, table(spark, sf_dir, "labels"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go.

    Null and empty texts have no passages; repeated rows go or stay together;
    without labels, and in an empty table, nothing goes.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays (five words, similarity 0.8 or more), that of the smallest id.

    Rows are compared by text alone, so repeated rows and repeated or null ids
    are near-duplicates or not like any others. Null and wordless texts all stay.
    """
    return minhash.keep_one(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go.

    Null and wordless texts have no windows and stay; repeated rows go or stay
    together; an empty benchmark removes nothing.
    """
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row; a null text counts as empty, other columns are dropped."""
    return bpe.digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality", quality),
    ("toxicity", clean),
    ("minhash", distinct),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: SQL can express neither the fitted models nor byte-pair merges; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
