"""Dependency graphs: shortest depths and paths, roll-ups of subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.core import VERDICTS, name_of, rank_of
from quillon.functions.folders import checkpoints, materialise


def roots(edges: DataFrame) -> DataFrame:
    """(node) of the parents that are nobody's child."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of all nodes below each root, shared ones once under each root; the root itself only on a circle."""
    # After the first step only edges below some edge can be met; these are often few.
    inner = materialise(edges.join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_semi"), "inner")
    frontier, ways = roots.select(F.col("node").alias("root"), "node").distinct(), edges
    met = None
    while True:
        steps = frontier.select("root", F.col("node").alias("parent")).join(ways, "parent").select("root", F.col("child").alias("node")).distinct()
        new = steps if met is None else steps.join(met, ["root", "node"], "left_anti")
        frontier = materialise(new.sortWithinPartitions("root"), "frontier")  # in this order distinct() has a root's rows together
        met, ways = frontier if met is None else met.union(frontier), inner
        if frontier.isEmpty():
            return met


def depths(edges: DataFrame, roots: DataFrame, most: int = 20) -> DataFrame:
    """(node, depth, parent) of nodes that the roots reach; the parent on a shortest way, the smallest of several.

    Breadth first: each round joins the frontier to the edges and leaves out nodes
    already met, so that a node is met once however many ways lead to it. Rounds
    are bounded by the depth; each one's lineage is cut by a checkpoint.
    """
    checkpoints(edges.sparkSession)
    met = roots.select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("parent")).distinct().checkpoint()
    frontier = met
    for depth in range(1, most + 1):
        steps = frontier.select(F.col("node").alias("parent")).join(edges, "parent").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("parent"))
        frontier = steps.join(met, "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent").checkpoint()
        if frontier.isEmpty():
            break
        met = met.union(frontier)
    return met


def paths(tree: DataFrame) -> DataFrame:
    """``tree`` (node, depth, parent) with ``path``, the ancestors from the root down; as many joins as the tree is deep."""
    most = tree.agg(F.max("depth")).first()[0] or 0
    done = tree.where("depth = 0").withColumn("path", F.array().cast("array<bigint>"))
    level = done
    for depth in range(1, most + 1):
        above = level.select(F.col("node").alias("parent"), F.concat("path", F.array("node")).alias("path"))
        level = tree.where(F.col("depth") == depth).join(above, "parent").select("node", "depth", "parent", "path")
        done = done.unionByName(level)
    return done


def with_orphans(tree: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree`` of ``paths`` and, at depth 1 with an empty path, the ``nodes`` that no root reaches."""
    lost = nodes.select("node").distinct().join(tree, "node", "left_anti")
    return tree.unionByName(lost.select("node", F.lit(1).alias("depth"), F.lit(None).cast("long").alias("parent"), F.array().cast("array<bigint>").alias("path")))


def from_paths(nodes: DataFrame) -> DataFrame:
    """(node, parent, is_root) of a tree known by its paths alone: the parent is the path's last element; where there is none or it is no node, the node is a root."""
    own = nodes.select("node", F.when(F.size("path") > 0, F.element_at("path", -1)).alias("parent"))
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known")).distinct()
    rows = own.join(known, "parent", "left")
    return rows.select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), F.col("known").isNull().alias("is_root"))


def at_depth(nodes: DataFrame, most: int) -> DataFrame:
    """Nodes at or above a depth: those that are shown opened."""
    return nodes.where(F.col("depth") <= most)


def pending(nodes: DataFrame, n: int = 50) -> DataFrame:
    """The first n nodes without a verdict by depth and name, each with how many more there are."""
    left = nodes.where("verdict is null")
    total = left.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("remaining"))  # one row
    return left.orderBy("depth", "name").limit(n).crossJoin(F.broadcast(total))


def rollup(nodes: DataFrame) -> DataFrame:
    """(node, subtree, flagged, worst) over each node and all below it, from (node, path, verdict): one pass, no recursion."""
    up = nodes.select(F.explode(F.concat("path", F.array("node"))).alias("node"), rank_of(F.col("verdict"), VERDICTS).alias("rank"))
    sums = up.groupBy("node").agg(F.count("*").alias("subtree"), F.count_if(F.col("rank") <= 2).alias("flagged"), F.min("rank").alias("worst"))
    return sums.withColumn("worst", name_of(F.col("worst"), VERDICTS))


def keep_ancestors(nodes: DataFrame, matching: DataFrame) -> DataFrame:
    """Nodes that match or have a match below them."""
    wanted = matching.select(F.explode(F.concat("path", F.array("node"))).alias("node")).distinct()
    return nodes.join(wanted, "node", "left_semi")


def risk_summary(nodes: DataFrame) -> DataFrame:
    """One row about a dependency set (node, depth, verdict)."""
    rank = rank_of(F.col("verdict"), VERDICTS)
    return nodes.agg(
        F.count("*").alias("total"), F.count_if(F.col("depth") <= 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"), F.count_if(F.col("verdict").isNotNull()).alias("analysed"),
        F.count_if(F.col("verdict").isNull()).alias("unanalysed"), F.count_if(rank <= 2).alias("flagged"), name_of(F.min(rank), VERDICTS).alias("worst"),
    )


def risk_by_verdict(nodes: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row: how many nodes are blocked (``blocked`` has node), and how many have each verdict."""
    rows = nodes.join(blocked.select("node", F.lit(True).alias("held")).distinct(), "node", "left")
    return rows.agg(F.count_if(F.col("held")).alias("blocked"), *(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS))
