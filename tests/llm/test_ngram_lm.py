import math
from collections import Counter

import duckdb
import pytest

from quillon.llm import ngram_lm
from quillon.llm.common import table


def close(a, b):
    return a == b or (a is not None and b is not None and abs(a - b) <= 1.5e-6 * max(1, abs(a)))


def compare(got, want):
    got, want = (sorted(map(tuple, rows), key=lambda r: (str(r[0]), r[1], r[2])) for rows in (got, want))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:2] == b[:2] and close(a[2], b[2]) and close(a[3], b[3])


@pytest.mark.parametrize("frequent, common", [(1_000_000, 1_000), (300, 40), (3, 2), (10**9, 1)])
def test_query_against_sql(spark, sf_dir, monkeypatch, frequent, common):
    """How many words are broadcast changes nothing."""
    monkeypatch.setattr(ngram_lm, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_lm, "COMMON", common)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    query = con.sql(ngram_lm.ORACLE)
    got = ngram_lm.op5_stupid_backoff(spark, sf_dir)
    assert got.columns == query.columns
    compare(got.collect(), query.fetchall())


def brute_force(docs, corpus):
    texts = [(t or "").encode().lower().split() for t in corpus]
    ones, twos = Counter(w for t in texts for w in t), Counter(p for t in texts for p in zip(t, t[1:]))
    total, out = sum(ones.values()), []
    for doc_id, text in docs:
        ws = (text or "").encode().lower().split()
        unigram = lambda w: math.log(ones.get(w, 0.5)) - math.log(max(total, 1))
        s = unigram(ws[0]) if ws else 0.0
        for v, w in zip(ws, ws[1:]):
            s += math.log(twos[v, w]) - math.log(ones[v]) if (v, w) in twos else math.log(0.4) + unigram(w)
        out.append((doc_id, len(ws), round(s, 6), round(round(s, 6) / len(ws), 6) if ws else None))
    return out


@pytest.mark.parametrize("frequent, common", [(1_000_000, 1_000), (20, 10), (3, 2)])
def test_foreign_documents_back_off(spark, sf_dir, monkeypatch, frequent, common):
    monkeypatch.setattr(ngram_lm, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_lm, "COMMON", common)
    rows = table(spark, sf_dir, "documents").orderBy("doc_id").limit(60).collect()
    corpus = [r.text for r in rows[:40]] + ["rare pair rare pair", "to be or not to be"]
    docs = [(r.doc_id, r.text) for r in rows[30:]] + [(900, "rare pair unheard rare not be"), (901, "unheard-of words only"), (902, None), (None, "be to"), (903, "unheard-of"), (903, "unheard-of")]
    got = ngram_lm.scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in corpus], "text string").selectExpr("1L AS doc_id", "text"))
    compare(got.collect(), brute_force(docs, corpus))


def test_odd_rows_and_foreign_text(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, " \n", 0), (3, "unheard-of the", 1), (3, "unheard-of the", 1), (4, "the " * 50_000, 2)], "doc_id long, text string, n_words int")
    rows = ngram_lm.scored(docs, table(spark, sf_dir, "documents")).collect()
    assert sorted(r.n_words for r in rows) == [0, 0, 0, 2, 2, 50_000]
    assert all((r.score == 0 and r.per_word is None) if r.n_words == 0 else r.score < 0 for r in rows)
    assert ngram_lm.scored(docs.limit(0), docs).collect() == []
    assert len(ngram_lm.scored(docs, docs.limit(0)).collect()) == 6
    compare(ngram_lm.scored(docs).collect(), brute_force([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in docs.collect()]))


def test_benchmark_backs_off(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    query, got = con.sql(ngram_lm.BACKOFF_ORACLE), ngram_lm.backoff_of_benchmark(spark, sf_dir)
    assert got.columns == query.columns
    compare(got.collect(), query.fetchall())
    seen = con.sql("select count(*) from documents d, benchmark b where contains(d.text, b.text)").fetchall()[0][0]
    assert seen < len(got.collect())
