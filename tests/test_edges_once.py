"""Rounds over a graph read its edges from what was written once."""

from pyspark.sql import functions as F

from quillon.plans import events


def test_edges_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 3), (4, 3)], "parent long, child long")
    edge = rows.select(F.udf(counted, "long")("parent").alias("parent"), "child")
    assert events.sbom_document(edge).count() == 2 and made.value == 5
    assert {(r.node, r.depth) for r in events.tree(edge).collect()} == {(1, 0), (5, 0), (2, 1), (3, 1), (4, 2)} and made.value == 10
