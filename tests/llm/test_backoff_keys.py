"""Of the corpus only keys of the foreign documents travel, where these are few."""

import math

from quillon.llm import ngram_lm


def test_small_documents_ask_for_their_keys_only(spark, monkeypatch):
    corpus = spark.createDataFrame([(k, f"the a{k} the b{k % 7} c d{k}") for k in range(300)], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "the a1 the b1 c d2 unheard"), (2, "d2"), (3, None), (4, "")], "doc_id long, text string")
    asked = []
    own = ngram_lm.exploded

    def watched(docs, held, hot, foreign, wanted=None):
        out = own(docs, held, hot, foreign, wanted) if wanted is not None else own(docs, held, hot, foreign)
        if not foreign:
            asked.append(out.count())
        return out

    monkeypatch.setattr(ngram_lm, "exploded", watched)
    monkeypatch.setattr(ngram_lm, "COMMON", 3)
    few = sorted(map(tuple, ngram_lm.scored(docs, corpus).collect()))
    monkeypatch.setattr(ngram_lm, "SMALL", -1)
    assert few == sorted(map(tuple, ngram_lm.scored(docs, corpus).collect()))
    assert asked[0] < asked[1] - 300 and math.isfinite(few[0][2])
