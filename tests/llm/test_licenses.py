import random
import re
from collections import Counter

import pytest

from quillon.llm import licenses
from quillon.llm.common import table
from quillon.llm.licenses import PHRASES, TEMPLATES, Automaton, Licences, words


def base(text):
    """Places of the phrases, word by word."""
    ws = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    found = [(i, label) for phrase, label in PHRASES for p in [phrase.encode().split()] for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    return len(ws), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = licenses.op13_licenses(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r.doc_id] or ""
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
        # A notice of the tables is a whole template.
        own = {label for label, t in TEMPLATES if b" " + b" ".join(words(t.encode())) + b" " in b" " + b" ".join(words(text.encode())) + b" "}
        assert own <= set(r.labels.split(",")) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}
        assert r.score == 1.0 if own else 0 <= r.score <= 1
        assert (r.score > 0) == (r.labels != "")
    assert any(r.n_base for r in rows) and any("cc-by-nc" in r.labels for r in rows)


def test_matching_statistics_against_all_runs():
    rng = random.Random(3)
    for alphabet in (2, 3, 6):
        sequences = [[rng.randint(1, alphabet) for _ in range(rng.randint(2, 30))] for _ in range(5)]
        automaton = Automaton(sequences)
        runs = Counter()
        for s in sequences:
            runs.update(tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
        text = [rng.randint(0, alphabet) for _ in range(300)]
        for i, (state, length) in enumerate(automaton.statistics(text), 1):
            want = next(n for n in range(i, -1, -1) if not n or tuple(text[i - n : i]) in runs)
            assert length == want
            if length:
                assert len(automaton.ends[state]) == runs[tuple(text[i - length : i])]
                assert all(sequences[k][end - length : end] == text[i - length : i] for k, end in automaton.ends[state])


@pytest.fixture(scope="module")
def held():
    return Licences()


def spans(held, text):
    return [(held.labels[k], a, b, n / held.sizes[k]) for a, b, k, n in held.scan(words(text.encode()))[1]]


@pytest.mark.parametrize("k", range(len(TEMPLATES)))
def test_whole_templates(held, k):
    label, text = TEMPLATES[k]
    n = len(words(text.encode()))
    assert (label, 2, 2 + n, 1.0) in spans(held, f"some words {text} and more")


def test_changed_templates(held):
    """Comment signs, line breaks, another holder and a changed word in twenty leave a template recognisable; half of it doesn't do."""
    mit = TEMPLATES[2][1]
    changed = mit.upper().split(" ")
    for i in range(9, len(changed), 20):
        changed[i] = "zzz"
    found = spans(held, "// " + "\n * ".join(changed))
    assert [x[0] for x in found] == ["mit"] and 0.75 <= found[0][3] < 1
    assert spans(held, " ".join(mit.split(" ")[:40])) == []
    assert spans(held, " ".join(reversed(mit.split(" ")))) == []
    shuffled = [" ".join(mit.split(" ")[i : i + 12]) for i in range(0, 84, 12)][::-1]
    assert spans(held, " ".join(shuffled)) == []


def test_repeated_and_neighbouring_notices(held):
    text = "Licensed under CC BY-NC 4.0. " * 3000 + TEMPLATES[2][1] * 200
    found = spans(held, text)
    assert Counter(x[0] for x in found) == {"cc-by-nc": 3000, "mit": 200}
    assert all(a[2] <= b[1] for a, b in zip(found, found[1:])) and {x[3] for x in found} == {1.0}


def test_clean_prose_has_none(held):
    text = "The software was licensed to the company under the terms agreed. You may obtain a copy of the book. Permission to use the hall is granted to any person who asks, without limitation."
    assert spans(held, text) == []


ODD = [
    (1, None), (None, "MIT License"), (2, ""), (3, " \n"), (4, "MIT"), (5, "mit mit license LICENSE the apache license"), (5, "mit mit license LICENSE the apache license"),
    (6, "mit-license, general_public license; General/Public/License"), (7, "é" * 100 + " mit license"), (8, "MITé license"), (9, "mit license " * 100_000), (10, "x" * 2_000_000),
]


def test_odd_rows(spark):
    """Nulls, ties, repeated rows, very long texts and clashing columns."""
    docs = spark.createDataFrame([(*r, "s", [1]) for r in ODD], "doc_id long, text string, spans string, places array<int>").repartition(2)
    rows = licenses.scan(docs, "f").collect()
    assert sorted((r.doc_id or 0, r.f.n_words, len(r.f.places)) for r in rows) == sorted((i or 0, *base(t)[:2]) for i, t in ODD)
    assert all(r.spans == "s" and r.places == [1] for r in rows)
    assert licenses.scan(docs.limit(0), "f").collect() == []
    kept = licenses.remove_labels(docs, ["mit"])
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 8, 10]


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "All rights are mine alone and so on"), (2, "all rights")], "doc_id long, text string")
    rows = licenses.scan(docs, "f", (("mine", "all rights are mine alone"),), (("and so on", "so"),)).orderBy("doc_id").collect()
    assert [[(s.label, s.start, s.end, s.share) for s in r.f.spans] for r in rows] == [[("mine", 0, 5, 1.0)], []]
    assert [[(p.start, p.label) for p in r.f.places] for r in rows] == [[(5, "so")], []]
    with pytest.raises(ValueError):
        Licences((("x", "one"),))
