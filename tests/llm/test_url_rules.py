from itertools import combinations, product

import duckdb

from quillon.llm import url_rules
from quillon.llm.common import table


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    query = con.sql(url_rules.ORACLE)
    got = url_rules.op9_url_rules(spark, sf_dir)
    assert got.columns == query.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, query.fetchall()))


def mine(frame, support, confidence):
    """The mined rules in all words that classes stand for."""
    rules, classes = url_rules.mined(frame, support, confidence)
    members = {c: [t for t, own in classes.items() if own == c] for c in classes.values()}
    return sorted(tuple(sorted(choice)) for r in rules.collect() for choice in product(*(members[c] for c in r.rule)))


def smallest(rules):
    return sorted(r for r in rules if not any(set(x) < set(r) for x in rules))


def test_mining_against_all_combinations(spark, sf_dir):
    rows = url_rules.listed(url_rules.parsed(table(spark, sf_dir, "pages")), url_rules.RULES).where("listed is not null").collect()
    least, rules = -(-len(rows) * 5 // 100), set()
    for n in range(1, max(len(r.tokens) for r in rows) + 1):
        for combo in {c for r in rows for c in combinations(sorted(r.tokens), n)}:
            have = [r.listed for r in rows if set(combo) <= set(r.tokens)]
            if have.count("block") >= least and have.count("block") / len(have) >= 0.8:
                rules.add(combo)
    frame = spark.createDataFrame(rows)
    assert mine(frame, 0.05, 0.8) == smallest(rules)


def test_rules_of_any_length(spark):
    """Only four tokens together tell a blocked page, and such a rule is mined."""
    parts = ["a", "b", "c", "d"]
    rows = [(sorted(f"path:{x}" for x in own), "block" if len(own) == 4 else "allow") for n in range(5) for own in combinations(parts, n) for _ in range(6)]
    frame = spark.createDataFrame(rows, "tokens array<string>, listed string")
    assert mine(frame, 0.02, 0.9) == [tuple(f"path:{x}" for x in parts)]


def test_pages_of_thirty_frequent_tokens(spark):
    """2^30 combinations of each page are frequent; the few that make rules are those of all combinations of up to three tokens."""
    always, tracking = [f"path:all{i}" for i in range(8)], [f"query:t{i}" for i in range(20)]
    rows = []
    for i in range(120):
        own = [*always, *(tracking if i % 2 else []), *(["host:a"] if i % 3 == 0 else []), *(["host:b"] if i % 5 < 2 else [])]
        rows.append((sorted(own), "block" if i % 2 and i % 3 == 0 or i % 10 == 7 else "allow"))
    frame = spark.createDataFrame(rows, "tokens array<string>, listed string")
    want = set()
    for n in (1, 2, 3):
        for combo in combinations(sorted({t for own, _ in rows for t in own}), n):
            have = [listed for own, listed in rows if set(combo) <= set(own)]
            if have.count("block") >= 0.02 * len(rows) and have.count("block") >= 0.9 * len(have) and not any(set(x) < set(combo) for x in want):
                want.add(combo)
    assert mine(frame, 0.02, 0.9) == sorted(want) and len(want) == 20


def test_rules_that_are_joined(spark, sf_dir):
    """A table of rules that isn't broadcast judges alike."""
    rows = url_rules.listed(url_rules.parsed(table(spark, sf_dir, "pages")), url_rules.RULES)
    rules, classes = url_rules.mined(rows.where("listed is not null and size(tokens) > 0"), 0.02, 0.7)
    assert rules.count() > 1
    told = [sorted((r.page_id, r.mined) for r in url_rules.blocked(rows, rules, classes, held).collect()) for held in (10**6, 0)]
    assert told[0] == told[1] and {x[1] for x in told[0]} == {True, False}


def test_a_very_long_url(spark):
    pages = spark.createDataFrame([(1, "http://a.org/fr/" + "x/" * 100_000), (2, "http://" + "h" * 100_000)], "page_id long, url string")
    rows = {r.page_id: r for r in url_rules.judged(pages).collect()}
    assert rows[1].rule == "org/fr/" and len(rows[1].path) == 200_004 and len(rows[2].host) == 100_000


URLS = {
    "http://EXAMPLE.net/en/x": ("example.net", "/en/x", "example.net/en/", "allow"),
    "http://a.example.net/e?en/": ("a.example.net", "/e", "net/", "block"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, None),
    "ftp://w.example.com/de/#x": ("w.example.com", "/de/", "example.com/de/", "block"),
    "http://net": ("net", "", None, None),
    "http://É.org/fr/://": ("É.org", "/fr/://", "org/fr/", "allow"),
    "http://net?/": ("net", "", None, None),
    "nothing": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "://": ("", "", None, "allow"),
}


def test_odd_urls(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(None, None, "x"), (0, "http://EXAMPLE.net/en/x", "x")], "page_id long, url string, host string")
    rows = url_rules.judged(pages).collect()
    assert len(rows) == len(URLS) + 2
    wants = dict(enumerate(URLS.values()))
    for r in rows:
        host, path, rule, verdict = wants[r.page_id] if r.page_id is not None else ("", "", None, "allow")
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
    assert url_rules.judged(pages.limit(0)).collect() == []
    assert {r.verdict for r in url_rules.judged(pages.where("url is null")).collect()} == {"allow"}
