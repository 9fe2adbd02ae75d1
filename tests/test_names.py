from itertools import product

import duckdb
from pyspark.sql import functions as F

from quillon.functions import names
from quillon.plans.typosquat import candidates, popular

CASES = [("recat", "react", 1), ("ca", "abc", 3), ("kitten", "sitting", 3), ("abc", "abc", 0), ("", "ab", 2), ("abcd", "badc", 2), ("lodash", "1odash", 1), ("a", "abcdef", 3)]


def test_distance():
    for a, b, want in CASES:
        assert names.distance(a, b, 2) == min(want, 3) == names.distance(b, a, 2)


def slow(a, b):
    t = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in product(range(1, len(a) + 1), range(1, len(b) + 1)):
        t[i, j] = min(t[i - 1, j] + 1, t[i, j - 1] + 1, t[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            t[i, j] = min(t[i, j], t[i - 2, j - 2] + 1)
    return t[len(a), len(b)]


def test_distance_against_full_table():
    words = ["".join(w) for n in range(5) for w in product("ab", repeat=n)]
    for a, b in product(words, words):
        assert names.distance(a, b, 2) == min(slow(a, b), 3)


def test_neighbours_are_all_pairs_within_two_edits(spark, sf_dir):
    """Also shows that the SQL's unrestricted distance finds the same pairs here."""
    from quillon.operators import typosquat

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    got = {(r.name, r.target): r.distance for r in typosquat.neighbours(candidates(part), popular(part)).collect()}
    form = lambda df: [(r.name, r.c) for r in df.select("name", names.canonical(F.col("name")).alias("c")).collect()]
    want = {}
    for (a, x), (b, y) in product(form(candidates(part)), form(popular(part))):
        d = slow(x, y)
        if a != b and d <= 2:
            want[a, b] = d
        assert (d <= 2) == (duckdb_distance(x, y) <= 2) if abs(d - 2) <= 1 else True
    assert got == want


CON = duckdb.connect()


def duckdb_distance(a, b):
    return CON.execute("SELECT damerau_levenshtein(?, ?)", [a, b]).fetchall()[0][0]


def test_folding(spark):
    rows = spark.createDataFrame([("rеасt", "react", True), ("l0dash", "lodash", False), ("Ex-press_js", "expressjs", False)], "name string, want string, alike boolean")
    for r in rows.select("*", names.canonical(F.col("name")).alias("c"), names.has_look_alike(F.col("name")).alias("h")).collect():
        assert (r.c, r.h) == (r.want, r.alike)


def test_long_names_are_all_pairs_within_two_edits(spark):
    """Around the length at which pieces take over from deletions: insertions, deletions, changes, and swaps across the cuts."""
    import random

    from quillon.operators import typosquat

    rng = random.Random(8)
    targets = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (5, 22, 23, 24, 25, 26, 27, 40, 41, 120) for _ in range(3)]
    names = set()
    for t in targets:
        for _ in range(40):
            w = list(t)
            for _ in range(rng.choice([1, 2, 2, 3])):
                i = rng.randrange(len(w) - 1)
                kind = rng.choice(["insert", "delete", "change", "swap", "swap"])
                w[i : i + 2] = {"insert": [w[i], "x", w[i + 1]], "delete": [w[i]], "change": ["y", w[i + 1]], "swap": [w[i + 1], w[i]]}[kind]
            names.add("".join(w))
    popular = spark.createDataFrame([(t, 1) for t in targets], "name string, downloads long")
    got = {(r.name, r.target) for r in typosquat.neighbours(spark.createDataFrame([(n,) for n in names], "name string"), popular).collect()}
    want = {(n, t) for n in names for t in targets if n != t and abs(len(n) - len(t)) <= 2 and (len(n) >= 5 and names_near(n, t))}
    assert got == want


def names_near(a, b):
    return names.distance(a, b, 2) <= 2
