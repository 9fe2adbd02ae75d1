import hashlib

from pyspark.sql.functions import lit

import corpus_pipeline
from quillon.llm import decontam, rff, toxicity
from quillon.llm.bpe import codec, default_vocabulary
from quillon.llm.common import materialise, table
from tests.llm.test_minhash import brute_force


def test_pipeline_against_brute_force(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.orderBy("doc_id").collect()
    model = rff.fit(docs, labels)
    quality = {r.doc_id: r.own for r in rff.scored(docs, model, "own").collect()}
    rows = [r for r in rows if quality[r.doc_id] >= 0.5]
    kept = docs.where(docs.doc_id.isin([r.doc_id for r in rows]))
    model = toxicity.fit(kept, labels)
    rows = [r for r in rows if isinstance(model, float) or model.score(r.text) < 0.5]
    comps = brute_force([r.text for r in rows], 5, 80)[1]
    rows = [r for i, r in enumerate(rows) if comps[i] == i]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    hit = {d[0] for d in decontam.brute_force([(r.doc_id, r.text) for r in rows], items) if d[5]}
    rows = [r for r in rows if r.doc_id not in hit]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(codec(default_vocabulary()).encode(r.text or "")).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_stages_keep_columns_and_stand_empty_input(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.collect() == []


def test_stages_stand_odd_rows_and_clashing_columns(spark, sf_dir):
    """Nulls, ties, repeated rows, very long texts, and columns with the names that stages use."""
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").limit(40)
    own = {"score": 1.5, "_score": "x", "found": 2, "row": 3, "component": 4, "signature": "s", "n": 5, "first": 6, "label": 7, "fold": 8, "rep": 9}
    extra = docs.limit(1).selectExpr("cast(NULL AS long) AS doc_id", "cast(NULL AS string) AS text", "lang", "source", "n_chars")
    long = docs.limit(1).selectExpr("77777L AS doc_id", "repeat('word and word ', 40000) AS text", "lang", "source", "n_chars")
    rows = docs.unionByName(docs.limit(3)).unionByName(extra).unionByName(extra).unionByName(long)
    for name, value in own.items():
        rows = rows.withColumn(name, lit(value))
    rows = materialise(rows, "odd")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, sf_dir)
        kept = out.collect()
        if name == "bpe":
            assert len(kept) == rows.count()
            continue
        assert out.columns == rows.columns and all(r[c] == v for r in kept for c, v in own.items())
        texts = sum(r.text is None for r in kept)
        assert texts in (0, 2) if name == "quality" else texts == 2
        if name == "minhash":
            assert len({r.text for r in kept if r.text}) == len([r for r in kept if r.text])
