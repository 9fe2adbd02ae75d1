"""Imitated names. Popular names are part names; candidates are deterministic changes of them."""

from pyspark.sql import functions as F

from quillon.functions import names as N
from quillon.operators import typosquat as T
from quillon.plans.registry import query

POPULAR = "popular AS (SELECT p_name AS name, CAST(floor(sum(p_retailprice)) AS BIGINT) AS downloads FROM part GROUP BY 1)"
CANDIDATE = f"""{POPULAR}, candidate AS (
  SELECT concat(substring(name, 1, 2), substring(name, 4)) AS name FROM popular UNION SELECT replace(name, ' ', '-') FROM popular UNION SELECT concat(replace(name, ' ', ''), 'js') FROM popular
  UNION SELECT concat('node-', name) FROM popular UNION SELECT concat(substring(name, 1, 3), substring(name, 5, 1), substring(name, 4, 1), substring(name, 6)) FROM popular UNION SELECT replace(name, 'o', '0') FROM popular)"""


def popular(part):
    return part.groupBy(F.col("p_name").alias("name")).agg(F.floor(F.sum("p_retailprice")).cast("long").alias("downloads"))


def candidates(part):
    n, cut = F.col("name"), lambda a, b=100: F.substring("name", a, b)
    made = [
        F.concat(cut(1, 2), cut(4)), F.replace(n, F.lit(" "), F.lit("-")), F.concat(F.replace(n, F.lit(" "), F.lit("")), F.lit("js")),
        F.concat(F.lit("node-"), n), F.concat(cut(1, 3), cut(5, 1), cut(4, 1), cut(6)), F.replace(n, F.lit("o"), F.lit("0")),
    ]
    return popular(part).select(F.explode(F.array(*made)).alias("name")).distinct()


FOLD = "replace(replace(replace(replace(lower({0}), '0', 'o'), '1', 'l'), '5', 's'), '3', 'e')"
CANON = "regexp_replace(" + FOLD + ", '[-_. ]', '', 'g')"
STRIP = "regexp_replace(lower({0}), '[-_. ]', '', 'g')"
# On these names the unrestricted distance is at most two exactly where the restricted one is (tests/test_names.py).
NEAR = f"""{CANDIDATE}, pairs AS (SELECT c.name, p.name AS target, downloads, CASE WHEN {CANON.format('c.name')} = {CANON.format('p.name')} THEN 0 ELSE damerau_levenshtein({CANON.format('c.name')}, {CANON.format('p.name')}) END AS distance
  FROM candidate c JOIN popular p ON c.name <> p.name), near AS (SELECT * FROM pairs WHERE distance = 0 OR (distance <= 2 AND length({CANON.format('name')}) >= 5))"""


@query(f"WITH {NEAR} SELECT name, target, distance, downloads, CAST(n AS BIGINT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, downloads DESC, target) AS n FROM near) WHERE n <= 5")
def typosquat_candidates_top5(part):
    return T.nearest(candidates(part), popular(part)).withColumn("position", F.col("position").cast("long"))


@query(f"""WITH {NEAR} SELECT n.name, n.target, distance, CASE WHEN p.name IS NOT NULL THEN 'popular' WHEN o.own >= 25000 THEN 'downloads' WHEN o.own > 0.1 * n.downloads THEN 'ratio' END AS reason
  FROM near n LEFT JOIN popular p ON p.name = n.name LEFT JOIN (SELECT name, length(name) * 3000 AS own FROM candidate WHERE length(name) % 2 = 0) o ON o.name = n.name""")
def typosquat_suppression(part):
    own = candidates(part).where(F.length("name") % 2 == 0).select("name", (F.length("name") * 3000).alias("downloads"))
    return T.suppression(T.neighbours(candidates(part), popular(part)), popular(part), own)


@query(f"WITH {CANDIDATE} SELECT c.name, arg_min(p.name, struct_pack(d := -downloads, n := p.name)) AS target FROM candidate c JOIN popular p ON {STRIP.format('c.name')} = {STRIP.format('p.name')} AND c.name <> p.name GROUP BY 1")
def typosquat_canonical(part):
    return T.separators(candidates(part), popular(part))


_AFFIX = ", ".join(f"('{x}', {i})" for i, x in enumerate(T.AFFIXES))


@query(f"""WITH {CANDIDATE}, affixes AS (SELECT * FROM (VALUES {_AFFIX}) t(affix, rank)), k AS (SELECT name, {STRIP.format('name')} AS key FROM candidate),
  cut AS (SELECT name, affix, rank, 0 AS side, substring(key, 1, length(key) - length(affix)) AS rest FROM k, affixes WHERE ends_with(key, affix) UNION ALL
          SELECT name, affix, rank, 1, substring(key, length(affix) + 1) FROM k, affixes WHERE starts_with(key, affix)),
  j AS (SELECT c.*, p.name AS target, downloads FROM cut c JOIN popular p ON {STRIP.format('p.name')} = c.rest AND p.name <> c.name WHERE length(rest) >= 5)
  SELECT name, target, affix FROM j QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, side, downloads DESC, target) = 1""")
def combosquat(part):
    return T.combinations(candidates(part), popular(part))


@query(f"WITH {CANDIDATE} SELECT name, {FOLD.format('name')} AS folded, {CANON.format('name')} AS canonical, name <> {FOLD.format('name')} AS changed FROM candidate")
def homoglyph_fold(part):
    n = F.col("name")
    return candidates(part).select("name", N.folded(n).alias("folded"), N.canonical(n).alias("canonical"), (n != N.folded(n)).alias("changed"))
