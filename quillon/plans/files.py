"""Files, texts, pages: provenance, text rules, payload clusters, campaigns. Files are documents."""

from pyspark.sql import functions as F

from quillon.functions.core import half_up
from quillon.operators import campaigns as C
from quillon.operators import provenance as P
from quillon.operators import text_rules as X
from quillon.operators.detect import FILE, INSTALL
from quillon.operators.scripts import BYTES
from quillon.plans.registry import query

EXT = "(['.js', '.py', '.md', '.min.js', '.json'])[1 + doc_id % 5]"
TREES = f"""f AS (SELECT doc_id, source AS package, concat(CASE WHEN doc_id % 9 = 0 THEN 'dist/' ELSE 'src/' END, doc_id, {EXT}) AS path, text FROM documents),
  l AS (SELECT package, path, sha256(text) AS hash FROM f), r AS (SELECT package, path, sha256(CASE WHEN doc_id % 11 = 0 THEN concat(text, '!') ELSE text END) AS hash FROM f WHERE doc_id % 7 <> 0
    UNION ALL SELECT package, concat('src/extra', doc_id, '.js'), sha256(text) FROM f WHERE doc_id % 13 = 0),
  t AS (SELECT coalesce(l.package, r.package) AS package, coalesce(l.path, r.path) AS path, CASE WHEN r.hash IS NULL THEN 'ONLY_PACKAGED' WHEN l.hash IS NULL THEN 'ONLY_SOURCE' WHEN l.hash = r.hash THEN 'IDENTICAL' ELSE 'MODIFIED' END AS status
    FROM l FULL JOIN r ON l.package = r.package AND l.path = r.path WHERE NOT regexp_matches(coalesce(l.path, r.path), '^dist/|\\.min\\.js$'))"""


def trees(documents):
    end = F.element_at(F.array(*map(F.lit, (".js", ".py", ".md", ".min.js", ".json"))), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.when(F.col("doc_id") % 9 == 0, "dist/").otherwise("src/"), F.col("doc_id").cast("string"), end)
    f = documents.select("doc_id", F.col("source").alias("package"), path.alias("path"), "text")
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    source = f.where("doc_id % 7 <> 0").select("package", "path", P.hash_raw(changed).alias("hash"))
    extra = f.where("doc_id % 13 = 0").select("package", F.concat(F.lit("src/extra"), F.col("doc_id").cast("string"), F.lit(".js")).alias("path"), P.hash_raw(F.col("text")).alias("hash"))
    return P.compare_trees(f.select("package", "path", P.hash_raw(F.col("text")).alias("hash")), source.union(extra))


@query(f"WITH {TREES} SELECT * FROM t")
def provenance_tree_compare(documents):
    return trees(documents)


@query(f"""WITH {TREES}, n AS (SELECT package, CAST(count_if(status = 'ONLY_PACKAGED') AS BIGINT) AS only_packaged, CAST(count_if(status = 'ONLY_SOURCE') AS BIGINT) AS only_source, CAST(count_if(status = 'MODIFIED') AS BIGINT) AS modified,
    CAST(count_if(status = 'IDENTICAL') AS BIGINT) AS identical, CAST(count_if(status = 'ONLY_PACKAGED' AND regexp_matches(path, '\\.(js|py)$')) AS BIGINT) AS executable_only_packaged FROM t GROUP BY 1),
  s AS (SELECT *, CASE WHEN modified + identical > 0 THEN modified / (modified + identical) END AS share FROM n)
  SELECT * EXCLUDE share, floor(share * 1000 + 0.5) / 1000 AS modified_share, CASE WHEN modified + identical = 0 THEN 'NO_TAG' WHEN executable_only_packaged > 0 OR only_packaged > 2 OR share > 0.15 THEN 'DIVERGENT' ELSE 'MATCH' END AS status FROM s""")
def provenance_status(documents):
    return P.status_of(trees(documents))


@query("""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY 1, 2)
  SELECT doc_id, floor((log2(sum(n)) - sum(n * log2(n)) / sum(n)) * 1e6 + 0.5) / 1e6 AS entropy FROM n GROUP BY 1""")
def string_entropy(documents):
    return X.character_entropy(documents, "doc_id", "text")


@query("SELECT doc_id, floor(length(text) / len(string_split(text, chr(10))) * 1000 + 0.5) / 1000 AS average_line FROM documents")
def avg_line_length(documents):
    return documents.select("doc_id", half_up(X.average_line(F.col("text")), 3).alias("average_line"))


@query("SELECT doc_id, len(m) AS runs, list_max(list_transform(m, lambda x: length(x))) AS longest FROM (SELECT doc_id, regexp_extract_all(text, '(?:[A-Za-z0-9+/]{40,}={0,2}|[0-9a-f]{40,})') AS m FROM documents) WHERE len(m) > 0")
def encoded_run_scan(documents):
    found = documents.select("doc_id", F.regexp_extract_all("text", F.lit(X.RUN), 0).alias("m")).where(F.size("m") > 0)
    return found.select("doc_id", F.size("m").cast("long").alias("runs"), F.array_max(F.transform("m", F.length)).cast("long").alias("longest"))


_OCTETS = "CAST(string_split(address, '.')[{}] AS INT)"
_A, _B, _C, _D = (_OCTETS.format(i) for i in (1, 2, 3, 4))


@query(f"""WITH a AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:\\d{{1,3}}\\.){{3}}\\d{{1,3}}\\b')) AS address FROM documents)
  SELECT doc_id, address, count(*) AS n, {_A} <= 255 AND {_B} <= 255 AND {_C} <= 255 AND {_D} <= 255 AND NOT ({_A} IN (0, 10, 127) OR {_A} >= 224 OR ({_A} = 172 AND {_B} BETWEEN 16 AND 31) OR ({_A} = 192 AND {_B} IN (0, 168)) OR ({_A} = 169 AND {_B} = 254)
    OR ({_A} = 198 AND {_B} IN (18, 19, 51)) OR ({_A} = 203 AND {_B} = 0)) AS routable FROM a GROUP BY 1, 2""")
def ipv4_routable_scan(documents):
    found = documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(X.IPV4), 0)).alias("address"))
    return found.groupBy("doc_id", "address").agg(F.count("*").alias("n")).withColumn("routable", X.routable(F.col("address")))


#: The rules that are patterns, of files, unreadable scripts and install scripts.
TEXT_RULES = list(dict.fromkeys([(rule, label, pattern) for rule, _, label, pattern in FILE + INSTALL] + BYTES))
#: What texts carry so that each rule finds something somewhere; a text carries two of them, by its id.
CARRIERS = [
    "a\u202eb", "\\x41" * 20, "~/.ssh/known_hosts", "id_rsa", "~/.aws/credentials", "~/.npmrc", "~/.docker/config.json", "~/.kube/config", "~/Library/Keychains", "~/.git-credentials", "~/.netrc", "/etc/passwd", "Cookies.sqlite",
    "~/.ethereum/x", "Wallet.DAT wallet.dat", "~/.bitcoin/x", "KeyStore", "exodus / exodus.wallet", "electrum/wallets", "nkbihfbeogaeaoehlefnkodbefgpgknn", "~/.config/solana", "ledger live", "https://discord.com/api/v9/webhooks/1", "https://api.telegram.org/bot1",
    "https://hooks.slack.com/services/1", "webhook.site", "pipedream.net", "x.ngrok.io", "x.oast.fun", "x.interact.sh", "burpcollaborator.net", "eval (x)", "Object.keys( process.env )", "...process.env",
    "curl -s", "WGET x", "bash  -c x", "sh -c x", "powershell x", "node -e x", "node --eval x", "python3 -c x", "nc -l", "IEX x", "base64 --decode", "atob (x)", "Buffer.from(x, 'base64')", "xxd -r", "base64.b64decode", "codecs.decode", "fromCharCode", "binascii.unhexlify",
    "/etc/shadow", "x.env", "$HOME", "http://x.io/y", "fetch(x)", "require('https')", "requests.get", "Invoke-WebRequest", "x > /etc/y", "cp x /usr/y", "~/.bashrc", "crontab", "/systemd/system", "chmod +x y", "x > $HOME/y", "~/.aws",
]


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_CARRIED = f"c AS (SELECT doc_id, concat(text, ' ', l[1 + doc_id % {len(CARRIERS)}], ' ', l[1 + doc_id * 7 % {len(CARRIERS)}]) AS text FROM documents, (SELECT [{', '.join(f"'{_quoted(c)}'" for c in CARRIERS)}] AS l))"


@query(f"WITH {_CARRIED} " + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id, '{_quoted(label)}' AS label, len(regexp_extract_all(text, '{_quoted(p)}')) AS hits FROM c WHERE regexp_matches(text, '{_quoted(p)}')" for r, label, p in TEXT_RULES))
def pattern_rules(documents):
    """All text rules in one pass over whole texts, each of which carries two more strings."""
    at = lambda n: F.element_at(F.array(*map(F.lit, CARRIERS)), (F.col("doc_id") * n % len(CARRIERS) + 1).cast("int"))
    return X.matches(documents.select("doc_id", F.concat("text", F.lit(" "), at(1), F.lit(" "), at(7)).alias("text")), "doc_id", "text", TEXT_RULES)


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'licensed under') THEN trim(regexp_extract(text, '[Ll]icensed under ([A-Za-z0-9 .-]+)', 1)) END AS license FROM documents WHERE contains(lower(text), 'licensed under')")
def license_scan(documents):
    return documents.where(F.contains(F.lower("text"), F.lit("licensed under"))).select("doc_id", F.trim(F.regexp_extract("text", r"[Ll]icensed under ([A-Za-z0-9 .-]+)", 1)).alias("license"))


ABOUT = ["a bundler", "Shell tools", "an HTTP client", "for react", "plain", "scaffolding", "dns server with a native build", "nextjs"]


@query(f"""WITH d AS (SELECT p_partkey, lower(concat(p_name, ' ', ({ABOUT!r})[1 + p_partkey % {len(ABOUT)}])) AS t, p_size * 11 AS dependents FROM part)
  SELECT p_partkey, CASE WHEN dependents >= 500 THEN 'FRAMEWORK' """ + " ".join(f"WHEN regexp_matches(t, '{'|'.join(w)}') THEN '{n}'" for n, w in X.CONTEXT_WORDS) + " ELSE 'UTILITY' END AS context FROM d")
def context_bucket(part):
    about = F.element_at(F.array(*map(F.lit, ABOUT)), (F.col("p_partkey") % len(ABOUT) + 1).cast("int"))
    return part.select("p_partkey", X.context(F.concat_ws(" ", "p_name", about), F.col("p_size") * 11).alias("context"))


@query("SELECT sha256(text) AS hash, count(*) AS files, count(DISTINCT source) AS packages, min(doc_id) AS first_file FROM documents GROUP BY 1 HAVING count(*) >= 2")
def duplicate_payload_clusters(documents):
    hashed = documents.select(P.hash_raw(F.col("text")).alias("hash"), "source", "doc_id")
    return hashed.groupBy("hash").agg(F.count("*").alias("files"), F.countDistinct("source").alias("packages"), F.min("doc_id").alias("first_file")).where("files >= 2")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE sha256(d.text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 17 = 0) AND d.doc_id % 17 <> 0")
def known_bad_hash_match(documents):
    """Files whose hash is that of a known bad one."""
    bad = documents.where("doc_id % 17 = 0").select(P.hash_raw(F.col("text")).alias("hash"))
    return documents.where("doc_id % 17 <> 0").withColumn("hash", P.hash_raw(F.col("text"))).join(bad, "hash", "left_semi").select("doc_id", "lang")


HOST = "lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''))"
INDICATOR = f"ind AS (SELECT 'endpoint' AS type, {HOST} AS value, page_id AS member, page_id % 1000 AS seen FROM pages UNION ALL SELECT 'hash', sha256(html), page_id, page_id % 1000 FROM pages)"


def indicators(pages):
    common = [F.col("page_id").alias("member"), (F.col("page_id") % 1000).alias("seen")]
    by_host = pages.select(F.lit("endpoint").alias("type"), C.host(F.col("url")).alias("value"), *common)
    return by_host.union(pages.select(F.lit("hash").alias("type"), F.sha2(F.col("html").cast("binary"), 256).alias("value"), *common))


CLUSTER = f"""{INDICATOR}, c AS (SELECT type, value, count(DISTINCT member) AS members, min(seen) AS first_seen, max(seen) AS last_seen, min(member) AS first_member FROM ind WHERE value NOT IN ({', '.join(f"'{h}'" for h in C.INFRASTRUCTURE)}) GROUP BY 1, 2)"""


@query(f"WITH {CLUSTER} SELECT *, sha256(concat(type, chr(0), value)) AS fingerprint, concat('Shared ', type, ': ', CASE WHEN length(value) > 64 THEN concat(substring(value, 1, 64), '…') ELSE value END) AS name FROM c WHERE members >= 2")
def campaign_list_min2(pages):
    return C.clusters(indicators(pages))


@query(f"WITH {CLUSTER} SELECT value AS host, members, first_seen, last_seen FROM c WHERE type = 'endpoint' ORDER BY members DESC, value LIMIT 20")
def campaign_by_host(pages):
    rows = C.clusters(indicators(pages).where("type = 'endpoint'"), 1)
    return rows.orderBy(F.desc("members"), "value").limit(20).select(F.col("value").alias("host"), "members", "first_seen", "last_seen")


@query(f"SELECT page_id, {HOST} AS host FROM pages")
def host_from_url(pages):
    return pages.select("page_id", C.host(F.col("url")).alias("host"))
