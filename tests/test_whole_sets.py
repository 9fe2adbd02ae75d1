"""Queries over all ids, against brute force."""

import json
from collections import defaultdict

from quillon.operators import graph
from quillon.plans import registry
from quillon.sources.views import VIEWS


def below(edges):
    """Nodes below each parent that is nobody's child."""
    children = defaultdict(set)
    for parent, child in edges:
        children[parent].add(child)
    found = {}
    for root in children.keys() - {c for _, c in edges}:
        met, todo = set(), [root]
        while todo:
            new = children[todo.pop()] - met
            met |= new
            todo += new
        found[root] = met
    return found


def test_sbom_has_all_roots_and_all_they_reach(spark, sf_dir):
    edge = VIEWS["edge"](spark, sf_dir)
    # Two more roots, above all others of this table, that share what they reach.
    more = spark.createDataFrame([(90_001, 90_003), (90_002, 90_003), (90_003, 90_004), (90_004, 90_003)], edge.schema)
    edge = edge.where("parent <= 3 OR parent >= 100000").union(more)
    want = below([tuple(r) for r in edge.collect()])
    got = defaultdict(set)
    for r in graph.reached(edge, graph.roots(edge)).collect():
        assert r.node not in got[r.root]
        got[r.root].add(r.node)
    assert got == want and got[90_001] == got[90_002] == {90_003, 90_004}


def test_queries_start_from_all_roots(spark, tmp_path):
    lines = [(supplier, supplier % 7) for supplier in range(1, 31)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    want = below([tuple(r) for r in VIEWS["edge"](spark, str(tmp_path)).collect()])
    documents = {r.root: {c["name"] for c in json.loads(r.document)["components"]} for r in registry.QUERIES["sbom_document"](spark, str(tmp_path)).collect()}
    assert documents == {root: {f"node-{n}" for n in nodes} for root, nodes in want.items()} and len(documents) == 30
    depths = {r.node: r.depth for r in registry.QUERIES["dependency_depth_bfs"](spark, str(tmp_path)).collect()}
    assert depths.keys() == want.keys() | set().union(*want.values()) and {n for n, d in depths.items() if d == 0} == want.keys()


def test_timeline_has_all_packages(spark, sf_dir):
    rows = registry.QUERIES["timeline_union"](spark, sf_dir)
    assert rows.count() == sum(spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("orders", "events"))
