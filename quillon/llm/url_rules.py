"""URL filters: a rule list, and association rules mined where the list is silent.

Pages that a listed rule fits are labelled by it. FP-growth mines combinations
of URL tokens among these; combinations that the block label follows with
enough support and confidence become rules, less those that contain a smaller
rule. They match through an inverted index: each rule is filed under one of its
tokens, and a URL only looks at rules filed under tokens it has.

Mining is Spark's parallel FP-growth over all labelled pages, and rules may have
any number of tokens. What can't be in a smallest rule is taken out before, since
a page with k tokens supports 2^k combinations: tokens that too few blocked pages
have, tokens that are rules by themselves, and tokens that all pages have. Tokens
that occur on the same labelled pages count as one class, and a page that has any
of them has the class. Rules stay a table: up to ``HELD`` of them, which are
counted first, make an index that is broadcast, so that judging is narrow; more
are joined to the pages' tokens.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import ascii_lower, materialise, table

SUPPORT, CONFIDENCE = 0.02, 0.9
#: Rules that are broadcast.
HELD = 100_000
BLOCK = "=block"
#: (verdict, host, path) of the listed rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def rest_of(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def parsed(pages: DataFrame) -> DataFrame:
    """``page_id``, ``host``, ``path`` and ``tokens`` of each row; null or without ``://``: all empty."""
    rest = F.coalesce(rest_of(F.col("url")), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.col("page_id"), F.col("url"), rest.alias("rest"), host.alias("host"), path.alias("path"))
    query = F.regexp_extract("rest", r"^[^?#]*\?([^#]*)", 1)
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(f"{kind}:"), x))
    segments = F.split(F.regexp_replace("path", r"[0-9]+", "0"), "/")
    tokens = F.concat(
        named("host", F.split("host", r"\.")),
        named("path", segments),
        named("query", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"^([^=]*)", 1))),
        named("scheme", F.array(F.regexp_extract("url", r"^([A-Za-z]*)://", 1))),
        named("mark", F.array(F.when(F.col("rest").contains("#"), F.lit("#")).otherwise(F.lit("")))),
    )
    return rows.select("page_id", "host", "path", F.when(F.col("rest") == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(tokens))).alias("tokens"))


class RuleList:
    """Listed rules by host; a look-up walks the host's suffixes."""

    def __init__(self, rules):
        self.by_host = defaultdict(list)
        for verdict, host, path in rules:
            self.by_host[host].append((path, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits; of equally long ones, that of the longer host."""
        labels, best = host.split("."), None
        for i in range(len(labels)):
            suffix = ".".join(labels[i:])
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start) and (best is None or len(suffix) + len(start) > len(best[0])):
                    best = (suffix + start, verdict)
        return best


def listed(rows: DataFrame, rules) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(RuleList(rules))

    @F.pandas_udf("rule string, verdict string")
    def match(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.match(h, p) or (None, None) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    return rows.withColumn("_m", match("host", "path")).select(*rows.columns, F.col("_m.rule").alias("rule"), F.col("_m.verdict").alias("listed"))


def classes_of(labelled: DataFrame, support: float, confidence: float) -> tuple[dict[str, str], list[str]]:
    """Classes by token, of tokens that may be in a rule of two or more, and those that are rules by themselves; each class is named by its least token.

    At most as many tokens as a page has, divided by ``support``. Tokens of one
    class occur on the same pages: as many, whose hashes have the same sums.
    """
    rows = labelled.select("tokens", (F.col("listed") == "block").alias("hit"), F.monotonically_increasing_id().alias("row"))
    n = labelled.count()
    counts = rows.select(F.explode("tokens").alias("t"), "hit", "row").groupBy("t").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.sum(F.xxhash64(F.lit(1), "row").cast("decimal(20,0)")).alias("h1"), F.sum(F.xxhash64(F.lit(2), "row").cast("decimal(20,0)")).alias("h2")
    )
    groups: defaultdict[tuple, list[str]] = defaultdict(list)
    alone = []
    for r in counts.where(F.col("hits") >= support * n).toLocalIterator():
        if r.hits >= confidence * r.n:
            alone.append(r.t)
        elif r.n < n:
            groups[r.n, r.hits, r.h1, r.h2].append(r.t)
    return {t: min(own) for own in groups.values() for t in own}, sorted(alone)


def mined(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, dict[str, str]]:
    """(rule) of combinations of classes that imply BLOCK, none of which contains another, and the classes by token.

    The table is written once. Without labelled pages it is empty.
    """
    spark = labelled.sparkSession
    classes, alone = classes_of(labelled, support, confidence)
    rules = spark.createDataFrame([([t],) for t in alone], "rule array<string>")
    if classes:
        # Whatever is taken out, all pages stay, since support and confidence are shares of them.
        baskets = labelled.select(in_classes(F.col("tokens"), classes).alias("items"), "listed")
        baskets = baskets.select(F.when(F.col("listed") == "block", F.concat("items", F.array(F.lit(BLOCK)))).otherwise(F.col("items")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
        more = model.associationRules.where(F.col("consequent") == F.array(F.lit(BLOCK))).select(F.array_sort("antecedent").alias("rule"))
        rules = rules.unionByName(smallest(materialise(more, "url-combinations")))
    return materialise(rules, "url-rules"), classes | {t: t for t in alone}


def in_classes(tokens: Column, classes: dict[str, str]) -> Column:
    """The classes that a page's tokens belong to."""
    names = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair)) if classes else F.create_map().cast("map<string,string>")
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: F.element_at(names, t)), lambda c: c.isNotNull()))


def filed(rules: DataFrame) -> DataFrame:
    """Each rule with the token of it that fewest rules have, under which it is filed."""
    rows = rules.withColumn("id", F.xxhash64("rule"))
    often = rows.select("id", "rule", F.explode("rule").alias("t")).join(rows.select(F.explode("rule").alias("t")).groupBy("t").count(), "t")
    return often.groupBy("id").agg(F.min_by("t", F.struct("count", "t")).alias("key"), F.first("rule").alias("rule")).select("key", "rule")


def smallest(rules: DataFrame) -> DataFrame:
    """The rules that contain no other one: each looks at those filed under its tokens."""
    inner = filed(rules).select("key", F.col("rule").alias("inner"))
    larger = rules.select("rule", F.explode("rule").alias("key")).join(inner, "key").where((F.size("inner") < F.size("rule")) & (F.size(F.array_except("inner", "rule")) == 0))
    return rules.join(larger.select("rule").distinct(), "rule", "left_anti")


class TokenIndex:
    """Rules filed under the token of theirs that fewest rules have."""

    def __init__(self, rules):
        often = Counter(t for r in rules for t in r)
        self.filed = defaultdict(list)
        for r in rules:
            self.filed[min(r, key=lambda t: (often[t], t))].append(frozenset(r))

    def matches(self, tokens) -> bool:
        own = frozenset(tokens)
        return any(r <= own for t in own for r in self.filed.get(t, ()))


def blocked(rows: DataFrame, rules: DataFrame, classes: dict[str, str], held: int = HELD) -> DataFrame:
    """``rows`` with ``mined``: whether a rule matches their tokens."""
    if rules.count() <= held:
        index = rows.sparkSession.sparkContext.broadcast((TokenIndex([tuple(r.rule) for r in rules.collect()]), classes))

        @F.pandas_udf("boolean")
        def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            found, names = index.value
            for part in batches:
                yield part.map(lambda tokens: found.matches({names[t] for t in tokens if t in names})).astype(bool)

        return rows.withColumn("mined", matches("tokens"))
    # Pages with the same classes are judged once.
    own = rows.withColumn("own", F.array_sort(in_classes(F.col("tokens"), classes)))
    kinds = own.select("own").distinct()
    hit = kinds.select("own", F.explode("own").alias("key")).join(filed(rules), "key").where(F.size(F.array_except("rule", "own")) == 0).select("own").distinct()
    return own.join(hit.withColumn("mined", F.lit(True)), "own", "left").fillna(False, ["mined"]).drop("own")


def judged(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    The verdict is the listed rule's, else ``block`` where a mined rule matches
    and ``allow`` otherwise; a URL that is null or has no ``://`` has no tokens
    and is allowed. Repeated rows are each judged; without labelled pages nothing
    is mined. Extra columns are ignored.
    """
    rows = materialise(listed(parsed(pages), rules), "urls")
    found, classes = mined(rows.where("listed is not null and size(tokens) > 0"), support, confidence)
    verdict = F.coalesce("listed", F.when(F.col("mined"), "block").otherwise("allow"))
    return blocked(rows, found, classes).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


_LISTED = "\n".join(
    f"    SELECT '{host}{path}' AS rule, '{verdict}' AS listed WHERE (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')" + (" UNION ALL" if k < len(RULES) - 1 else "")
    for k, (verdict, host, path) in enumerate(RULES)
)
ORACLE = f"""
WITH RECURSIVE cut AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT row_number() OVER () AS k, page_id, url, rest,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1) AS query FROM cut
), named AS (
  SELECT *, CASE WHEN rest = '' THEN [] ELSE list_distinct(
      list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host:' || x)
      || list_transform(list_filter(string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/'), lambda x: x <> ''), lambda x: 'path:' || x)
      || list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^([^=]*)', 1)), lambda x: x <> ''), lambda x: 'query:' || x)
      || list_transform(list_filter([regexp_extract(url, '^([A-Za-z]*)://', 1)], lambda x: x <> ''), lambda x: 'scheme:' || x)
      || CASE WHEN contains(rest, '#') THEN ['mark:#'] ELSE [] END) END AS tokens FROM split
), judged AS (
  SELECT n.*, r.rule, r.listed FROM named n LEFT JOIN LATERAL (SELECT * FROM (
{_LISTED}
  ) ORDER BY length(rule) DESC LIMIT 1) r ON true
), labelled AS (
  SELECT k, listed = 'block' AS hit, tokens FROM judged WHERE listed IS NOT NULL AND len(tokens) > 0
), token AS (SELECT k, hit, unnest(tokens) AS t FROM labelled),
least AS (SELECT ceil({SUPPORT} * count(*)) AS n FROM labelled),
often AS (SELECT t FROM token GROUP BY t HAVING count(*) >= (SELECT n FROM least)),
few AS (SELECT token.* FROM token JOIN often USING (t)),
subsets AS (
  SELECT k, hit, [t] AS items, t AS last FROM few
  UNION ALL
  SELECT s.k, s.hit, list_append(s.items, f.t), f.t FROM subsets s JOIN few f ON s.k = f.k AND f.t > s.last
), rules AS (
  SELECT items FROM subsets GROUP BY items HAVING count_if(hit) >= (SELECT n FROM least) AND count_if(hit) / count(*) >= {CONFIDENCE}
), blocked AS (SELECT DISTINCT j.k FROM judged j JOIN rules r ON list_has_all(j.tokens, r.items))
SELECT page_id, host, path, rule, coalesce(listed, CASE WHEN k IN (SELECT k FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
