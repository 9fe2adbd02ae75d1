import random

import numpy as np
import pytest

from quillon.llm import minhash
from quillon.llm.common import table
from quillon.llm.components import connected_components


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def brute_force(texts, width, percent):
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    links = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [len(s) for s in sets], components(len(texts), links)


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_table_against_brute_force(spark, sf_dir, width, percent):
    rows = table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    sizes, comps = brute_force([r.text for r in rows], width, percent)
    got = {r.doc_id: r for r in minhash.duplicates(table(spark, sf_dir, "documents"), width, percent).collect()}
    for i, r in enumerate(rows):
        assert (got[r.doc_id].n_shingles, got[r.doc_id].component_id) == (sizes[i], rows[comps[i]].doc_id)
        assert got[r.doc_id].kept == (comps[i] == i)


def test_chains_and_odd_rows(spark, monkeypatch):
    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 9999)}" for _ in range(120)]
    texts, words = [], base
    for i in range(60):  # a chain: neighbours link, ends don't
        texts.append(" ".join(words))
        words = [*words[3:], *(f"c{i}-{k}" for k in range(3))]
    texts += [None, "", "  \n", "one", "ONE ", "one two", "Ünï one two", "ünï one two", " ".join(base) * 2, "x " * 30000]
    for copies in range(3):
        texts += [" ".join(base[:60])] * 3
    sizes, comps = brute_force(texts, 3, 85)
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, "one", "z"), (63, "one", "z")], "doc_id long, text string, component_id string")
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "GROUP", 2)
    monkeypatch.setattr(minhash, "SHINGLES", 1000)
    monkeypatch.setattr(minhash, "HOT", 20)
    rows = minhash.duplicates(docs, 3, 85).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], comps[r.doc_id], comps[r.doc_id] == r.doc_id)
    kept = minhash.keep_one(docs, 3, 85)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(comps))
    assert minhash.duplicates(docs.limit(0), 3, 85).collect() == []


def test_units_are_the_cheaper_way(spark):
    """A dense group is one cluster, a long chain is taken by its buckets."""
    dense = [(b, n) for b in range(20) for n in range(10)]
    chain = [(100 + k, 50 + k + d) for k in range(60) for d in (0, 1)]
    members = spark.createDataFrame([(b, n, n) for b, n in dense + chain], "bucket long, node long, component long")
    rows = minhash.units(members, minhash.Salts(members, "bucket")).collect()
    assert sorted(r.node for r in rows if r.whole) == list(range(10))
    assert sorted((r.unit, r.node) for r in rows if not r.whole) == sorted(chain)


def test_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(1, a, 0), (2, a, 1), (2, b, 2), (3, c, 3), (3, c, 4), (None, c, 5), (None, None, 6), (4, "", 7), (4, "", 8)], "doc_id long, text string, row int")
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = [r.row for r in kept.collect()]
    assert sorted(r for r in rows if r not in (3, 4)) == [0, 2, 6, 7, 8] and len(rows) == 6
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.duplicates(docs, 3, 85).collect())
    want = [("1", 28, "1", True), ("2", 28, "1", False), ("2", 28, "2", True), ("3", 28, "3", True), ("3", 28, "3", True), ("4", 0, "4", True), ("4", 0, "4", True), ("None", 0, "None", True), ("None", 28, "None", True)]
    assert got == want


def test_pairs_at_the_threshold(spark):
    """Planted pairs just at or above the threshold are linked, those just below it aren't."""
    rnd, texts = random.Random(8), []
    for k in range(120):
        words = [f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(80, 400))]
        near = words[:]
        # Each replaced word, far from the others, ends three shingles and makes three.
        most = int((len(words) - 2) * 0.15 / (3 * 1.85)) + k % 2
        for i in range(most):
            near[10 + i * ((len(words) - 20) // max(most, 1))] = f"n{k}-{i}"
        texts += [" ".join(words), " ".join(near)]
    comps = brute_force(texts, 3, 85)[1]
    assert 40 < sum(a != b for a, b in zip(comps, range(len(comps)))) < 120
    got = {r.doc_id: r.component_id for r in minhash.duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85).collect()}
    assert [got[i] for i in range(len(texts))] == comps


def test_posterior_bounds():
    bounds = minhash.least_matches(85)
    assert [n for n, _ in bounds] == [32, 64, 96, 128] and all(0 < m < n for n, m in bounds)
    rnd = np.random.default_rng(2)
    left = rnd.integers(0, 1 << 32, (2000, 128), dtype=np.uint32)
    for similarity, least, most in ((0.85, 0.999, 1), (0.4, 0, 0.001)):
        right = np.where(rnd.random(left.shape) < similarity, left, left + np.uint32(1))
        assert least <= minhash.plausible(left, right, 85).mean() <= most


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 520)] + [(i, 1000) for i in range(600, 700)] + [(5, 5)]
    want = components(1001, edges)
    got = connected_components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: want[x] for e in edges for x in e if e[0] != e[1]}
    assert len(got) == len({r.node for r in got})


def test_mostly_wordless_rows(spark):
    """Nine tenths of the rows have no word, or no id; all come back, by themselves."""
    docs = spark.createDataFrame([(i, (None, "", " \n")[i % 3]) for i in range(900)] + [(900 + i, f"same text of some words {i // 50}") for i in range(100)] + [(None, "same text of some words 0")] * 50, "doc_id long, text string")
    rows = minhash.duplicates(docs, 3, 85).collect()
    assert len(rows) == 1050
    assert {(r.n_shingles, r.component_id == r.doc_id, r.kept) for r in rows if r.doc_id is not None and r.doc_id < 900} == {(0, True, True)}
    assert {r.component_id for r in rows if r.doc_id is not None and r.doc_id >= 900} == {900, 950}
    assert {(r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id is None} == {(4, None, True)}
