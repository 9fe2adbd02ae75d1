import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quillon.llm import divergence
from quillon.llm.divergence import Trie, common, packed, unpacked


def brute_force(docs, least, best):
    docs = [(lang or "", source or "", [m.lower() for m in re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode())]) for lang, source, text in docs]
    seen, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        groups[lang].add(source)
        seen[lang].update(set(terms))
        counts[lang, source].update(terms)
    rows = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:best]
            rows += [(lang, s, part, item.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found, 1)]
    return sorted(rows)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    got, want = divergence.op12_source_divergence(spark, sf_dir), con.sql(divergence.ORACLE)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


ODD = [
    *[("en", f"s{i % 5}", "The the THE quick brown fox " + "é" * i) for i in range(20)], *[("en", None, "only here, only here")] * 12, *[(None, None, "nothing Élan élan")] * 3, *[(None, "x", None)] * 2,
    ("de", "alone", "ein Wort"), ("en", "", "1 2 3"), ("en", "s1", "x" * 1_000_000), ("fr", "a", "un"), ("fr", "b", ""), *[("日本", "s\U0001f600", "字\U0001f600 字�")] * 11, *[("日本", "s�", "字�")] * 2,
]


@pytest.mark.parametrize("pour, held, block, sample", [(150_000, 200_000, 4096, 20_000), (0, 1, 3, 20_000), (10, 5, 1, 6)])
def test_odd_rows(spark, monkeypatch, pour, held, block, sample):
    """Nulls, ties, repeated rows, a very long term, code points beyond the surrogates; and tries that are let go early and cut often."""
    for name, value in (("POUR", pour), ("HELD", held), ("BLOCK", block), ("SAMPLE", sample)):
        monkeypatch.setattr(divergence, name, value)
    docs = spark.createDataFrame([(*r, 1, "?") for r in ODD], "lang string, source string, text string, rank int, term string").repartition(3)
    for least, best in ((10, 10), (2, 3)):
        assert sorted(map(tuple, divergence.audit(docs, least, best).collect())) == brute_force(ODD, least, best)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_tries_are_merged_as_counters_are():
    rng = random.Random(5)
    words = ["".join(rng.choice("aäb") for _ in range(rng.randint(1, 9))).encode() for _ in range(3000)]
    whole, merged = Counter(words), Trie()
    for k in range(4):
        part = Trie()
        for chunk in (words[k::4][:300], words[k::4][300:]):
            part.extend(sorted((w, {None: 1, "s": n}) for w, n in Counter(chunk).items()))
        leaves = list(part.walk())
        assert leaves == sorted(leaves, key=lambda x: x[0])
        merged.extend(unpacked(packed(leaves)))
    assert [(t, c["s"]) for t, c in merged.walk()] == sorted(whole.items())
    assert merged.leaves == len(whole)


def test_common_prefix():
    for a, b, n in ((b"", b"x", 0), (b"abc", b"abd", 2), (b"ab", b"abc", 2), (b"x" * 10**6 + b"a", b"x" * 10**6 + b"b", 10**6)):
        assert common(a, b) == common(b, a) == n


def test_shares_are_exact():
    for total in (1, 3, 999, 10**9 + 7, 8 * 10**15):
        counts = sorted({0, 1, total // 3, total - 1, total})
        assert divergence.share(np.array(counts), total).tolist() == [1 + 10**9 * c // total for c in counts]
