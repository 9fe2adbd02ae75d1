"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise

ROUNDS = 60


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) of one partition to at most one edge a node, towards the smallest node it reaches here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    for rows in batches:
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    if root:
        yield pd.DataFrame([(x, find(x)) for x in root], columns=["a", "b"], dtype="int64")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of an edge (a, b) and the smallest node of its component.

    Edges may repeat, in either direction; those with a null or from a node to
    itself add nothing. Each round is a few joins and partial aggregations by
    node; its edges are written to the shared folder, so that a lost executor
    costs one round. Edges never exceed the input's number by more than a small
    factor, and no component is ever gathered in one task.
    """
    schema = "a long, b long"
    now = materialise(edges.where("a <> b").select("a", "b").mapInPandas(forest, schema), "edges")
    before = None
    for _ in range(ROUNDS):
        ends = now.union(now.select("b", "a"))
        least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ends.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        now = materialise(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
