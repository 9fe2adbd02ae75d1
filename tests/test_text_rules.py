import re

import pytest

from quillon.operators import text_rules
from quillon.plans.files import CARRIERS, TEXT_RULES


@pytest.mark.parametrize(
    "pattern, strings",
    [
        ("abc", ["abc"]), ("(?i)ABC", ["abc"]), ("ab|cd", ["ab", "cd"]), ("ab|c*", None), (r"a\d+bcd", ["bcd"]), ("(?:ab){2,}", ["ab"]), ("(ab)?cde*", ["cd"]), ("[xy]", ["x", "y"]), ("[^x]", None), (r"\bfoo(?:bar|baz)", ["fooba"]), ("x(?:long|er)", ["er", "long"]), (".*", None),
    ],
)
def test_required_strings(pattern, strings):
    assert text_rules.required(pattern) == strings


def test_every_rule_asks_for_a_string_and_has_a_carrier():
    for _, label, pattern in TEXT_RULES:
        strings = text_rules.required(pattern)
        hits = [c for c in CARRIERS if re.search(pattern, c)]
        assert strings and hits, label
        assert all(any(x in c.lower() for x in strings) for c in hits)


def test_each_rule_has_a_row(spark, sf_dir):
    from quillon.plans.registry import QUERIES

    rows = QUERIES["pattern_rules"](spark, sf_dir).select("rule_id", "label").distinct().collect()
    assert {tuple(r) for r in rows} == {(r, label) for r, label, _ in TEXT_RULES}


def test_same_as_running_every_expression(spark):
    texts = [(i, c * (i % 3 + 1)) for i, c in enumerate(CARRIERS)] + [(900, None), (901, ""), (902, "nothing of it"), (903, "x" * 1_000_000 + " CURL "), (903, "curl")]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "k long, t string, hits int")
    got = sorted(map(tuple, text_rules.matches(docs, "k", "t", TEXT_RULES).collect()))
    want = sorted((k, r, label, len(re.findall(p, t, re.A))) for k, t in texts if t for r, label, p in TEXT_RULES if re.search(p, t, re.A))
    assert got == want
    assert text_rules.matches(docs.limit(0), "k", "t", TEXT_RULES).collect() == []
