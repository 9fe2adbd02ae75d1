from collections import defaultdict
from itertools import permutations

import duckdb
import pytest

from quillon.llm import filter_audit
from quillon.llm.common import table


def brute_force(docs, labels):
    """Each order is applied document by document."""
    least = {}
    for doc_id, _, text in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    parts = defaultdict(list)
    for doc_id, source, text in docs:
        t = text or ""
        words = t.encode().split()
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t)}
        fails |= {"D": any(c in "#$%&*|" for c in t), "E": doc_id is not None and least[t] < doc_id}
        parts[source or ""].append(({k for k, x in fails.items() if x}, doc_id))
    rows = {}
    for part, own in parts.items():
        total = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before, left = set(order[: step - 1]), set(order[:step])
                removed = [i for fails, i in own if f in fails and not fails & before]
                total[f] += len(removed)
                rows[part, order, step] = [
                    sum(not fails & left for fails, _ in own), len(removed), sum(f in fails and bool(fails & before) for fails, _ in own),
                    sum(fails == {f} for fails, _ in own), sum(i in good for i in removed), sum(i in toxic for i in removed),
                ]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(total[order[step - 1]])
    return sorted((*k, *v) for k, v in rows.items())


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = filter_audit.op11_filter_audit(spark, sf_dir), con.sql(filter_audit.ORACLE)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


ODD = [
    (1, "a", "few words"), (2, "a", "few words"), (2, "b", "few words"), (2, "a", "few words"), (1, "b", "few words"), (None, "a", "few words"), (None, None, None),
    (3, None, None), (4, "", ""), (5, "a", " \n"), (6, "a", "UPPER # CASE"), (7, "a", "w " * 300), (8, "b", " ".join(map(str, range(300)))), (9, "b", " ".join(map(str, range(300)))),
    (10, "b", "é" * 50 + "A"), (11, "b", "x" * 3_000_000), (12, "a", "x" * 3_000_000), (7, "c", "another text of the same id"), (-1, "c", "w " * 300),
]
LABELS = [(1, 1, 0), (1, None, 1), (2, 0, 1), (None, 1, 1), (8, 1, 1), (9, 1, None), (99, 1, 1)]


@pytest.mark.parametrize("chain_bytes", [32 << 20, 0])
def test_odd_rows(spark, monkeypatch, chain_bytes):
    """Nulls, ties, repeated rows and ids, long texts and clashing columns; and partitions that let their texts go at once."""
    monkeypatch.setattr(filter_audit, "CHAIN_BYTES", chain_bytes)
    docs = spark.createDataFrame([(*r, 0, "x") for r in ODD], "doc_id long, source string, text string, mask int, n string").repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit(docs, labels).collect()))
    assert got == brute_force(ODD, LABELS)
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert len(filter_audit.audit(docs, labels.limit(0)).collect()) == len(got)


def test_texts_that_share_a_fingerprint(spark, monkeypatch):
    """Collisions are told apart by the whole text."""
    rows = [(("same", (text, 0, i, {"s": 1}))) for i, text in enumerate([b"one", b"two", b"one", b"three", b"two"])]
    got = sorted(filter_audit.resolved(rows))
    assert got == [(0, "s", 0, 1), (1, "s", 0, 1), (2, "s", filter_audit.COPY, 1), (3, "s", 0, 1), (4, "s", filter_audit.COPY, 1)]


def test_one_row_of_a_hot_text_leaves_a_partition():
    rows = [(i, "s", b"hot text") for i in range(1000, 0, -1)]
    out = list(filter_audit.gathered(rows))
    assert len([x for x in out if x[1][0] is not None]) == 1
    assert sum(bool(x[1][1] & filter_audit.COPY) for x in out) == 999


def test_brute_force_over_a_table(spark, sf_dir):
    docs = [(r.doc_id, r.source, r.text) for r in table(spark, sf_dir, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in table(spark, sf_dir, "labels").collect()]
    assert sorted(map(tuple, filter_audit.op11_filter_audit(spark, sf_dir).collect())) == brute_force(docs, labels)
