import numpy as np
import pytest

from quillon.llm import pivots
from quillon.llm.common import table
from tests.llm.test_minhash import components


def brute_force(vectors, cosine=0.9):
    """(links, component) of each vector, from all pairs."""
    good = [x is not None and len(x) > 0 and all(v is not None and np.isfinite(v) for v in x) and any(v != 0 for v in x) for x in vectors]
    links = []
    for a in range(len(vectors)):
        for b in range(a):
            if good[a] and good[b] and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links.append((a, b))
    counts = np.bincount(np.array(links, int).ravel(), minlength=len(vectors)) if links else np.zeros(len(vectors), int)
    return counts.tolist(), components(len(vectors), links)


def check(rows, ids, vectors):
    counts, comps = brute_force(vectors)
    got = {r.vec_id: r for r in rows}
    for i, v in enumerate(ids):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (counts[i], ids[comps[i]], comps[i] == i), v


def test_query_against_all_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    check(pivots.op3_pivots(spark, sf_dir).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_dense_groups_copies_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 16)
    rnd = np.random.default_rng(8)
    centre = rnd.normal(size=24)
    vectors = [*(centre + rnd.normal(size=(150, 24)) * 0.3), *rnd.normal(size=(100, 24)), *([centre * 2] * 40)]
    vectors = [v.tolist() for v in vectors]
    df = spark.createDataFrame([(i, v, i) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, n_links long")
    check(pivots.near_duplicates(df).collect(), list(range(len(vectors))), vectors)


def test_odd_rows(spark):
    vectors = [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1.0, 0.0], [2.0, 0.1], [1.0], [-3.0], [2.0], [1e300, 0.0], [1e-300, 1e-302]]
    df = spark.createDataFrame([*enumerate(vectors), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = pivots.near_duplicates(df).collect()
    assert len(rows) == len(vectors) + 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in (*range(6), 9))
    assert got[6] == (3, 6, True) and got[7] == (3, 6, False) and got[11] == (3, 6, False) and got[12] == (3, 6, False)
    assert got[8] == (1, 8, True) and got[10] == (1, 8, False)
    again = spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")
    assert [tuple(r) for r in pivots.near_duplicates(again).collect()] == [(1, 2, 1, True)] * 3
    assert pivots.near_duplicates(again.limit(0)).collect() == []


@pytest.mark.parametrize("most", [180, 700])
def test_recall_of_planted_pairs(spark, monkeypatch, most):
    """Pairs just above the threshold among others, against all pairs; the threshold of the contract is 0.9."""
    rnd = np.random.default_rng(12)
    base = rnd.normal(size=(2_000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rnd.normal(size=base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rnd.uniform(0.901, 0.92, (len(base), 1))
    vectors = np.concatenate([base, base * cosine + other * np.sqrt(1 - cosine**2)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(pivots, "PIVOTS", most / len(vectors) ** 0.5)
    got = {r.vec_id: r.component_id for r in pivots.near_duplicates(df).collect()}
    recall = np.mean([got[i + len(base)] == got[i] for i in range(len(base))])
    assert recall > 0.98


def test_thinned_and_prefix():
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(400, 16))
    x = np.concatenate([x, x[:50]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    own = pivots.thinned(x, 60)
    assert len(own) <= 60 and (np.triu(own @ own.T, 1) < pivots.ALIKE[-1]).all()
    assert [pivots.prefix(n) for n in (16, 256, 512, 4_096, 16_384)] == [8, 8, 10, 16, 20]


def test_mostly_unusable_vectors(spark):
    """Nine tenths of the vectors link with nothing; all come back, by themselves."""
    rows = [(i, (None, [], [0.0, 0.0], [float("nan"), 1.0])[i % 4]) for i in range(900)] + [(900 + i, [1.0, 0.01 * i]) for i in range(10)] + [(None, [1.0, 0.0])] * 40
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 950
    assert {(r.n_links, r.component_id == r.vec_id, r.kept) for r in got if r.vec_id is not None and r.vec_id < 900} == {(0, True, True)}
    assert {(r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id >= 900} == {(9, 900)}
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None} == {(0, None, True)}
