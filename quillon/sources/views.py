"""The domain's tables, projected from the driver's tables, as DataFrames and as SQL for the oracle.

Packages are customers, releases and analyses are orders, and rule hits are
line items; each view's SQL says the same as its DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.core import FAMILIES, SEVERITIES, VERDICTS

#: Short names and sizes of the rule families, and the rules switched off here.
CODES = ["INS", "OBF", "CAP", "TYP", "MNT", "PRV"]
SIZES = [7, 7, 9, 6, 6, 6]
DISABLED = ["Q-MNT-004", "Q-PRV-006"]
#: Modifiers of the CAPABILITY family by context.
CONTEXTS = [("BUILD_TOOL", 0.3), ("SYSTEM", 0.4), ("NETWORK", 0.6), ("FRAMEWORK", 0.8), ("UTILITY", 1.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def package(spark, d) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    where = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").cast("long").alias("org_id"), F.col("r_name").alias("ecosystem"))
    return (
        table(spark, d, "customer")
        .select(F.col("c_custkey").alias("package_id"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("org_id"), F.col("c_mktsegment").alias("license"), F.col("c_acctbal").alias("downloads"))
        .join(F.broadcast(where), "org_id")
    )


def analysis(spark, d) -> DataFrame:
    owner = table(spark, d, "customer").select(F.col("c_custkey").alias("package_id"), F.col("c_nationkey").cast("long").alias("org_id"))
    status = F.when(F.col("o_orderstatus") == "O", "QUEUED").when(F.col("o_orderstatus") == "P", "PARTIAL").otherwise("COMPLETED")
    verdict = F.element_at(F.array(*map(F.lit, VERDICTS)), F.substring("o_orderpriority", 1, 1).cast("int"))
    return (
        table(spark, d, "orders")
        .select(
            F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("package_id"), status.alias("status"), verdict.alias("verdict"),
            F.col("o_orderdate").alias("created_at"), F.when(status != "QUEUED", F.col("o_orderdate")).alias("completed_at"),
            (F.floor("o_totalprice") % 12000).alias("duration_ms"),
        )
        .join(owner, "package_id")
    )


def release(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("package_id"), F.col("o_orderkey").alias("release_id"), F.col("o_orderdate").alias("published_at"))


def hit(spark, d) -> DataFrame:
    family = (F.round(F.col("l_discount") * 100 + 0.0).cast("int") % 6).cast("int")
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("f") + 1)
    modifier = F.element_at(F.array(*(F.lit(m) for _, m in CONTEXTS)), (F.col("l_suppkey") % 5 + 1).cast("int"))
    severity = (
        F.when(F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "O", "CRITICAL").otherwise("HIGH"))
        .when(F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "O", "MEDIUM").otherwise("LOW"))
        .otherwise("INFO")
    )
    return (
        table(spark, d, "lineitem")
        .withColumn("f", family)
        .select(
            F.col("l_orderkey").alias("analysis_id"), F.col("l_linenumber").cast("long").alias("line"), at(FAMILIES).alias("family"),
            F.format_string("Q-%s-%03d", at(CODES), 1 + F.col("l_partkey") % at(SIZES)).alias("rule_id"),
            (F.col("l_quantity") * 0.6).alias("weight"), (0.2 + 10 * F.col("l_tax")).alias("confidence"),
            F.when(F.col("f") == 2, modifier).otherwise(1.0).alias("modifier"), severity.alias("severity"),
            F.col("l_suppkey").alias("file_path"), (F.col("l_linenumber") * 10).cast("long").alias("line_start"),
            (F.col("l_linenumber") * 10 + F.col("l_quantity")).cast("long").alias("line_end"), F.col("l_shipdate").alias("seen_at"),
        )
    )


def rule(spark, d=None) -> DataFrame:
    rows = [(f"Q-{code}-{i:03d}", family, i, f"Q-{code}-{i:03d}" not in DISABLED) for code, family, n in zip(CODES, FAMILIES, SIZES) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "rule_id string, family string, number long, enabled boolean")


def edge(spark, d) -> DataFrame:
    """(parent, child) of a dependency graph with some depth and shared nodes."""
    lines = table(spark, d, "lineitem")
    top = lines.select(F.col("l_suppkey").alias("parent"), (100_000 + F.col("l_partkey") % 500).alias("child"))
    deep = lines.select((100_000 + F.col("l_partkey") % 500).alias("parent"), (200_000 + F.col("l_partkey") % 97).alias("child"))
    deeper = lines.select((200_000 + F.col("l_partkey") % 97).alias("parent"), (300_000 + F.col("l_partkey") % 41).alias("child"))
    return top.union(deep).union(deeper).distinct()


def _case(column: str, values, quote: bool = True) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN " + (f"'{v}'" if quote else str(v)) for i, v in enumerate(values)) + " END"


_F = "CAST(round(l_discount * 100 + 0.0) AS INT) % 6"
VIEW_SQL = {
    "package": """SELECT c_custkey AS package_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS org_id, c_mktsegment AS license, c_acctbal AS downloads, r_name AS ecosystem
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "analysis": f"""SELECT o_orderkey AS analysis_id, o_custkey AS package_id, CASE o_orderstatus WHEN 'O' THEN 'QUEUED' WHEN 'P' THEN 'PARTIAL' ELSE 'COMPLETED' END AS status,
        {_case("CAST(substring(o_orderpriority, 1, 1) AS INT) - 1", VERDICTS)} AS verdict, o_orderdate AS created_at,
        CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS completed_at, CAST(floor(o_totalprice) AS BIGINT) % 12000 AS duration_ms, CAST(c_nationkey AS BIGINT) AS org_id
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "release": "SELECT o_custkey AS package_id, o_orderkey AS release_id, o_orderdate AS published_at FROM orders",
    "hit": f"""SELECT l_orderkey AS analysis_id, CAST(l_linenumber AS BIGINT) AS line, {_case(_F, FAMILIES)} AS family,
        format('Q-{{}}-{{:03d}}', {_case(_F, CODES)}, 1 + l_partkey % ({_case(_F, SIZES, False)})) AS rule_id, l_quantity * 0.6 AS weight, 0.2 + 10 * l_tax AS confidence,
        CASE WHEN {_F} = 2 THEN CAST({_case("l_suppkey % 5", [m for _, m in CONTEXTS], False)} AS DOUBLE) ELSE 1.0 END AS modifier,
        CASE l_returnflag WHEN 'R' THEN CASE l_linestatus WHEN 'O' THEN 'CRITICAL' ELSE 'HIGH' END WHEN 'A' THEN CASE l_linestatus WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END ELSE 'INFO' END AS severity,
        l_suppkey AS file_path, CAST(l_linenumber * 10 AS BIGINT) AS line_start, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS line_end, l_shipdate AS seen_at FROM lineitem""",
    "rule": "SELECT * FROM (VALUES "
    + ", ".join(f"('Q-{c}-{i:03d}', '{f}', {i}, {str(f'Q-{c}-{i:03d}' not in DISABLED).lower()})" for c, f, n in zip(CODES, FAMILIES, SIZES) for i in range(1, n + 1))
    + ") t(rule_id, family, number, enabled)",
    "edge": """SELECT DISTINCT l_suppkey AS parent, 100000 + l_partkey % 500 AS child FROM lineitem
        UNION SELECT 100000 + l_partkey % 500, 200000 + l_partkey % 97 FROM lineitem UNION SELECT 200000 + l_partkey % 97, 300000 + l_partkey % 41 FROM lineitem""",
}
VIEWS = {"package": package, "analysis": analysis, "release": release, "hit": hit, "rule": rule, "edge": edge}
