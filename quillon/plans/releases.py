"""Release forensics. Versions and maintainer events are made of orders."""

from pyspark.sql import functions as F

from quillon.operators import releases as R
from quillon.plans.registry import query

GAPS = """gaps AS (SELECT *, (epoch_us(published_at) - lag(epoch_us(published_at)) OVER (PARTITION BY package_id ORDER BY published_at, release_id)) / 86400000000 AS gap,
  count(*) OVER (PARTITION BY package_id) AS n, row_number() OVER (PARTITION BY package_id ORDER BY published_at, release_id) AS i FROM release)"""
VERSIONS = """versions AS (SELECT o_custkey AS package_id, o_orderkey AS release_id, o_orderdate AS published_at, o_orderkey % 7 AS major, o_orderkey % 11 AS minor, o_orderkey % 4 = 0 AS pre,
  concat(o_orderkey % 7, '.', o_orderkey % 11, '.0', CASE WHEN o_orderkey % 4 = 0 THEN '-rc' ELSE '' END) AS version FROM orders)"""


def versions(orders):
    k = F.col("o_orderkey")
    text = F.concat((k % 7).cast("string"), F.lit("."), (k % 11).cast("string"), F.lit(".0"), F.when(k % 4 == 0, "-rc").otherwise(""))
    return orders.select(F.col("o_custkey").alias("package_id"), k.alias("release_id"), F.col("o_orderdate").alias("published_at"), text.alias("version"))


@query(f"WITH {GAPS} SELECT package_id, release_id, floor(gap * 1000 + 0.5) / 1000 AS gap_days, CASE WHEN gap >= 540 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM gaps WHERE gap >= 180")
def release_gaps_dormancy(release):
    return R.dormancy(release)


@query(f"""WITH {GAPS}, m AS (SELECT g.package_id, g.release_id, g.gap, (SELECT quantile_cont(p.gap, 0.5) FROM gaps p WHERE p.package_id = g.package_id AND p.i < g.i) AS median FROM gaps g WHERE n >= 5)
  SELECT package_id, release_id, floor(gap * 1000 + 0.5) / 1000 AS gap_days, floor(median * 1000 + 0.5) / 1000 AS median_days, floor(gap / median * 10 + 0.5) / 10 AS multiple FROM m WHERE median > 0 AND gap > 8 * median""")
def cadence_anomaly(release):
    return R.cadence(release)


@query(f"""WITH {VERSIONS}, w AS (SELECT *, lag(version) OVER o AS previous, lag(major) OVER o AS pmajor, lag(minor) OVER o AS pminor, lag(pre) OVER o AS ppre FROM versions WINDOW o AS (PARTITION BY package_id ORDER BY published_at, release_id)),
  k AS (SELECT *, CASE WHEN major - pmajor >= 2 THEN 'jump' WHEN (major, minor, NOT pre) < (pmajor, pminor, NOT ppre) THEN 'out of order' END AS kind FROM w WHERE previous IS NOT NULL)
  SELECT package_id, release_id, previous, version, kind FROM k WHERE kind IS NOT NULL""")
def version_jump(orders):
    return R.version_jumps(versions(orders))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS package_id, o_orderkey % 13 AS actor, o_orderdate AS added FROM orders WHERE o_orderkey % 3 = 0)
  SELECT DISTINCT r.package_id, release_id, actor FROM release r JOIN e ON e.package_id = r.package_id AND published_at >= added AND published_at <= added + INTERVAL 30 DAY""")
def maintainer_recent(release, orders):
    events = orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("package_id"), (F.col("o_orderkey") % 13).alias("actor"), F.col("o_orderdate").alias("at"), F.lit("ADDED").alias("type"))
    return R.new_maintainers(release, events)


@query(f"WITH {VERSIONS} SELECT package_id, release_id, version, CAST(row_number() OVER (PARTITION BY package_id ORDER BY major DESC, minor DESC, NOT pre DESC, release_id) AS BIGINT) AS position FROM versions")
def semver_sort(orders):
    from pyspark.sql import Window

    rows = versions(orders).withColumn("key", R.semver(F.col("version")))
    order = Window.partitionBy("package_id").orderBy(F.desc("key"), "release_id")
    return rows.select("package_id", "release_id", "version", F.row_number().over(order).cast("long").alias("position"))


@query("SELECT p.package_id, count(*) AS maintainers, max(downloads) * 20 AS downloads FROM package p JOIN (SELECT DISTINCT package_id, release_id % 3 AS actor FROM release) r USING (package_id) GROUP BY 1 HAVING count(*) = 1 AND max(downloads) * 20 >= 100000")
def single_maintainer_popular(package, release):
    actors = release.select("package_id", (F.col("release_id") % 3).alias("actor")).distinct()
    return package.join(actors, "package_id").groupBy("package_id").agg(F.count("*").alias("maintainers"), (F.max("downloads") * 20).alias("downloads")).where("maintainers = 1 and downloads >= 100000")


@query("""SELECT package_id, published_at AS at, 'release' AS kind, release_id AS id FROM release UNION ALL
  SELECT user_id AS package_id, ts, event_type, event_id FROM events""")
def timeline_union(release, events):
    """Releases and events of all packages in one list, newest first."""
    left = release.select("package_id", F.col("published_at").alias("at"), F.lit("release").alias("kind"), F.col("release_id").alias("id"))
    right = events.select(F.col("user_id").alias("package_id"), F.col("ts").alias("at"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"))
    return left.unionByName(right).orderBy(F.desc("at"), "kind", "id")
