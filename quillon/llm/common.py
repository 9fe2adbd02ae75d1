"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.folders import materialise, shared_dir  # noqa: F401  used by the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with as many underscores in front as make it new among the columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def open_fs(uri: str):
    """(file system, path) of a URI; runs on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, limit: int) -> DataFrame:
    """(doc_id, text, label) of at most about ``limit`` labelled documents outside ``held_out``; one row for each id, of repeated ones that of the least text.

    Rows are picked by a hash of their id, so each labelled row has the same
    chance. A document with several labels gets their majority (ties: 1); null
    labels and ids count as none. The labels are bounded by ``limit`` and so are
    broadcast; documents are read once.
    """
    usable = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out)
        .groupBy("doc_id")
        .agg((F.avg(column) >= 0.5).cast("int").alias("label"))
    )
    n = usable.count()
    share = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = usable.where(share < limit / n) if n > limit else usable
    # One row for each id: of repeated ids the least text.
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
