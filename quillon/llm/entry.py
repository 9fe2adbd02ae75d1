"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from quillon.llm import bpe, decontam, divergence, filter_audit, licenses, minhash, ngram_lm, pivots, repair, rff, toxicity, url_rules, warc

QUERIES = {
    "op1_bpe_roundtrip": bpe.op1_bpe_roundtrip,
    "op2_warc": warc.op2_warc,
    "op3_pivots": pivots.op3_pivots,
    "op4_repair": repair.op4_repair,
    "op5_stupid_backoff": ngram_lm.op5_stupid_backoff,
    "backoff_of_benchmark": ngram_lm.backoff_of_benchmark,
    "op6_quality": rff.op6_quality,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_minhash": minhash.op8_minhash,
    "op9_url_rules": url_rules.op9_url_rules,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_licenses": licenses.op13_licenses,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op5_stupid_backoff": ngram_lm.ORACLE,
    "backoff_of_benchmark": ngram_lm.BACKOFF_ORACLE,
    "op9_url_rules": url_rules.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_source_divergence": divergence.ORACLE,
}
