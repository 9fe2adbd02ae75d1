"""Detection rules over files and install scripts: patterns are rows of data, and one scan serves all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.core import top_per
from quillon.functions.text import excerpt, line_of
from quillon.operators import scripts
from quillon.operators.text_rules import entropy

#: Fixed values: (rule, confidence, label, pattern) of install scripts.
INSTALL = [
    ("Q-INS-002", 0.9, "curl", r"(?i)\bcurl\b"), ("Q-INS-002", 0.9, "wget", r"(?i)\bwget\b"), ("Q-INS-002", 0.9, "bash -c", r"(?i)\bbash\s+-c\b"), ("Q-INS-002", 0.9, "sh -c", r"(?i)\bsh\s+-c\b"),
    ("Q-INS-002", 0.9, "powershell", r"(?i)\bpowershell\b"), ("Q-INS-002", 0.9, "node -e", r"(?i)\bnode\s+-e\b"), ("Q-INS-002", 0.9, "node --eval", r"(?i)\bnode\s+--eval\b"), ("Q-INS-002", 0.9, "python -c", r"(?i)\bpython3?\s+-c\b"),
    ("Q-INS-002", 0.9, "eval", r"\beval\b"), ("Q-INS-002", 0.9, "netcat", r"(?i)\bnc\s+-"), ("Q-INS-002", 0.9, "Invoke-Expression", r"\bIEX\b"),
    ("Q-INS-003", 0.85, "base64 -d", r"(?i)\bbase64\s+(?:-d|--decode)\b"), ("Q-INS-003", 0.85, "atob", r"(?i)\batob\s*\("), ("Q-INS-003", 0.85, "Buffer.from", r"""(?i)Buffer\.from\s*\([^)]*['"]base64['"]"""), ("Q-INS-003", 0.85, "xxd", r"(?i)\bxxd\s+-r\b"),
    ("Q-INS-003", 0.85, "b64decode", r"(?i)\bbase64\.b64decode\b"), ("Q-INS-003", 0.85, "codecs", r"(?i)\bcodecs\.decode\b"), ("Q-INS-003", 0.85, "fromCharCode", r"\bfromCharCode\b"), ("Q-INS-003", 0.85, "unhexlify", r"(?i)\bunhexlify\b"),
    ("Q-INS-004", 0.9, ".npmrc", r"\.npmrc\b"), ("Q-INS-004", 0.9, ".ssh", r"\.ssh\b"), ("Q-INS-004", 0.9, ".aws", r"\.aws\b"), ("Q-INS-004", 0.9, "docker", r"\.docker/config\.json"), ("Q-INS-004", 0.9, "kube", r"\.kube/config"),
    ("Q-INS-004", 0.9, "passwd", r"/etc/passwd"), ("Q-INS-004", 0.9, "shadow", r"/etc/shadow"), ("Q-INS-004", 0.9, ".env", r"\.env\b"), ("Q-INS-004", 0.9, "git", r"\.git-credentials"), ("Q-INS-004", 0.9, "key", r"id_rsa|id_ed25519"),
    ("Q-INS-004", 0.9, ".netrc", r"\.netrc\b"), ("Q-INS-004", 0.9, "home", r"HOME\s*\+|\$HOME|%USERPROFILE%"),
    ("Q-INS-005", 0.85, "url", r"""(?i)https?://[^\s'"$]+"""), ("Q-INS-005", 0.85, "curl", r"(?i)\bcurl\b"), ("Q-INS-005", 0.85, "wget", r"(?i)\bwget\b"), ("Q-INS-005", 0.85, "fetch", r"\bfetch\s*\("), ("Q-INS-005", 0.85, "require", r"""\brequire\s*\(\s*['"]https?['"]\s*\)"""),
    ("Q-INS-005", 0.85, "python", r"(?i)\burllib\b|\brequests\.(?:get|post)\b"), ("Q-INS-005", 0.85, "netcat", r"(?i)\bnc\s+-"), ("Q-INS-005", 0.85, "web request", r"(?i)\bInvoke-WebRequest\b"),
    ("Q-INS-006", 0.8, "redirect", r">\s*/(?:etc|usr|bin|sbin|opt|var|root)/"), ("Q-INS-006", 0.8, "copy", r"\b(?:cp|mv)\s+[^\s]+\s+/(?:etc|usr|bin|sbin|opt|var|root)/"), ("Q-INS-006", 0.8, "profile", r"~/\.(?:bashrc|zshrc|profile|bash_profile)"),
    ("Q-INS-006", 0.8, "crontab", r"\bcrontab\b"), ("Q-INS-006", 0.8, "service", r"LaunchAgents|systemd/system|\.service\b"), ("Q-INS-006", 0.8, "chmod", r"\bchmod\s+\+x\b"), ("Q-INS-006", 0.8, "home", r">\s*\$HOME/"),
]
#: Fixed values: (rule, confidence, label, pattern) of whole texts of files.
FILE = [
    ("Q-OBF-005", 0.95, "direction", r"[‪-‮⁦-⁩‎‏؜]"), ("Q-OBF-007", 0.75, "escapes", r"(?:\\x[0-9a-fA-F]{2}){20,}"),
    ("Q-CAP-005", 0.9, "ssh", r"\.ssh/"), ("Q-CAP-005", 0.9, "key", r"id_rsa|id_ed25519|id_ecdsa"), ("Q-CAP-005", 0.9, "aws", r"\.aws/(?:credentials|config)"), ("Q-CAP-005", 0.9, "npmrc", r"\.npmrc"), ("Q-CAP-005", 0.9, "docker", r"\.docker/config\.json"),
    ("Q-CAP-005", 0.9, "kube", r"\.kube/config"), ("Q-CAP-005", 0.9, "keychain", r"Library/Keychains"), ("Q-CAP-005", 0.9, "git", r"\.git-credentials"), ("Q-CAP-005", 0.9, "netrc", r"\.netrc"), ("Q-CAP-005", 0.9, "accounts", r"/etc/shadow|/etc/passwd"), ("Q-CAP-005", 0.9, "cookies", r"[Cc]ookies\.sqlite"),
    ("Q-CAP-006", 0.9, "ethereum", r"\.ethereum/"), ("Q-CAP-006", 0.9, "wallet", r"wallet\.dat"), ("Q-CAP-006", 0.9, "bitcoin", r"\.bitcoin/"), ("Q-CAP-006", 0.9, "keystore", r"(?i)keystore"), ("Q-CAP-006", 0.9, "exodus", r"(?i)Exodus.*exodus\.wallet"),
    ("Q-CAP-006", 0.9, "electrum", r"(?i)Electrum/wallets"), ("Q-CAP-006", 0.9, "extension", r"nkbihfbeogaeaoehlefnkodbefgpgknn"), ("Q-CAP-006", 0.9, "solana", r"\.config/solana"), ("Q-CAP-006", 0.9, "ledger", r"(?i)Ledger Live"),
    ("Q-CAP-008", 0.95, "discord", r"(?i)discord(?:app)?\.com/api/(?:v\d+/)?webhooks"), ("Q-CAP-008", 0.95, "telegram", r"(?i)api\.telegram\.org/bot"), ("Q-CAP-008", 0.95, "slack", r"(?i)hooks\.slack\.com/services"), ("Q-CAP-008", 0.95, "webhook.site", r"(?i)webhook\.site"),
    ("Q-CAP-008", 0.95, "pipedream", r"(?i)pipedream\.net"), ("Q-CAP-008", 0.95, "tunnel", r"(?i)requestbin|\.ngrok\.io|\.ngrok-free\.app"), ("Q-CAP-008", 0.95, "oast", r"(?i)oast\.(?:fun|live|site|online|pro|me)"), ("Q-CAP-008", 0.95, "interact", r"(?i)\.interact\.sh"), ("Q-CAP-008", 0.95, "burp", r"(?i)burpcollaborator\.net"),
]
#: Modules by rule.
MODULES = {"Q-CAP-001": ["child_process"], "Q-CAP-002": ["net", "dgram", "dns", "dns/promises", "tls"], "Q-CAP-003": ["vm", "worker_threads"]}
#: Hooks that npm runs on its own and other lifecycle hooks, python files that run on install, and the factor for scripts that don't run on their own.
AUTO, OTHER_HOOKS, PYTHON, NOT_AUTO = ["preinstall", "install", "postinstall"], ["prepare", "prepublish", "prepublishOnly", "preuninstall", "postuninstall"], ["setup.py", "setup.cfg", "conftest.py"], 0.6
#: Literals looked at, their least length and entropy; encoded runs; packed files; evidence kept for a rule.
LITERALS, LITERAL, BITS, RUN, PACKED_BYTES, PACKED_LINE, KEPT = 500, 64, 4.8, 1_024, 4_096, 500, 25

IMPORT = r"""(?:\brequire\s*\(\s*|\bfrom\s+|\bimport\s*\(\s*|\bimport\s+)['"]([^'"]+)['"]"""
QUOTED = r"""(?s)(["'`])((?:\\.|(?!\1)[^\\]){32,}+)\1"""
#: Files of prose, and the confidence in what hides there.
PROSE, IN_PROSE = r"(?i)\.(?:md|txt|json|ya?ml)$", 0.8
#: Files that a script runs; native files, what declares them, and how many are reported.
TARGET = r"""(?:^|[\s;&|])(?:node|npx|ts-node|python3?)\s+(?:--?\S+\s+)*['"]?([^\s'";|&]+)"""
NATIVE, GYP, NATIVE_DEPENDENCY, NATIVE_SCRIPT, NATIVE_WORD, MOST_NATIVE = r"(?i)\.(?:node|so|dylib|dll|exe|wasm)$", r"(?:^|/)binding\.gyp$", "node-gyp|prebuild|node-pre-gyp|node-addon-api|bindings", "node-gyp|prebuild", "(?i)native|binding|addon|ffi", 10


def _found(text: Column, patterns, factor: Column) -> Column:
    """An array of (rule_id, confidence, label, position) of the patterns that occur."""
    hits = [F.struct(F.lit(r).alias("rule_id"), (F.lit(c) * factor).alias("confidence"), F.lit(label).alias("label"), F.regexp_instr(text, F.lit(p)).alias("position")) for r, c, label, p in patterns]
    return F.filter(F.array(*hits), lambda h: h["position"] > 0)


def surfaces(packages: DataFrame, files: DataFrame) -> DataFrame:
    """What runs on install: (package, path, label, body, auto_run), from scripts (a map) and top-level python files."""
    scripts = packages.select("package", F.explode("scripts").alias("label", "body")).where(F.col("label").isin(AUTO + OTHER_HOOKS))
    left = scripts.select("package", F.lit("package.json").alias("path"), "label", "body", F.col("label").isin(AUTO).alias("auto_run"))
    right = files.where(F.col("path").isin(PYTHON) & F.col("text").isNotNull())
    return left.unionByName(right.select("package", "path", F.col("path").alias("label"), F.col("text").alias("body"), F.lit(True).alias("auto_run")))


def install_signals(packages: DataFrame, files: DataFrame) -> DataFrame:
    rows = surfaces(packages, files)
    exists = rows.select("package", "path", F.lit("Q-INS-001").alias("rule_id"), F.lit(0.95).alias("confidence"), "label", F.lit(1).alias("line"), F.substring("body", 1, 200).alias("excerpt")).where(rows.auto_run)
    # What doesn't run on its own weighs less.
    hits = _found(F.col("body"), INSTALL, F.when(F.col("auto_run"), 1.0).otherwise(NOT_AUTO))
    scanned = rows.select("package", "path", "body", F.explode(hits).alias("h"))
    return exists.unionByName(scanned.select("package", "path", "h.rule_id", "h.confidence", "h.label", line_of(F.col("body"), F.col("h.position")).alias("line"), excerpt(F.col("body"), F.col("h.position")).alias("excerpt"))).unionByName(entry_signals(packages, files))


def entry_signals(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Q-INS-007: an install script runs a file that is obfuscated, packed, mostly strings, or does nothing but evaluate text.

    Only files that a script runs are scanned for the last two reasons.
    """
    text = F.col("text")
    packed = (F.octet_length(text) >= PACKED_BYTES) & (F.length(text) / F.size(F.split(text, "\n")) > PACKED_LINE)
    reason = F.when(text.rlike(r"(?m)^\s*(?:var|const|let)\s+_0x[0-9a-f]+"), "names").when(text.rlike(r"\\x[0-9a-fA-F]{2}(?:\\x[0-9a-fA-F]{2}){10,}"), "escapes").when(packed, "packed")
    target = F.explode(F.transform(F.regexp_extract_all("body", F.lit(TARGET), 1), lambda t: F.regexp_replace(t, r"^\./", "")))
    targets = surfaces(packages, files).select("package", F.col("path").alias("from"), "label", target.alias("target")).where("target not like '-%'").distinct()
    paths = targets.select("*", F.posexplode(F.array("target", F.concat("target", F.lit(".js")))).alias("rank", "path"))
    # The file of that very name, else the one with the ending.
    run = top_per(paths.join(files.select("package", "path", "text"), ["package", "path"]), ["package", "from", "label", "target"], 1, F.asc("rank"))
    run = run.withColumn("read", F.when(reason.isNull(), scripts.reading(text))).select("*", F.coalesce(reason, scripts.payload_reason(text, F.col("read"))).alias("reason"), F.substring(text, 1, 200).alias("excerpt")).where("reason is not null")
    return run.select("package", "path", F.lit("Q-INS-007").alias("rule_id"), F.lit(0.8).alias("confidence"), F.concat_ws(": ", "label", "reason").alias("label"), F.lit(1).alias("line"), "excerpt").distinct()


def native_signals(packages: DataFrame, files: DataFrame) -> DataFrame:
    """Q-CAP-009: native files of packages that declare none by binding.gyp, scripts, dependencies (a map) or keywords; the last two are looked at where ``packages`` has them."""
    says = F.exists(F.map_values("scripts"), lambda s: s.rlike(NATIVE_SCRIPT))
    declared = F.coalesce(says, F.lit(False))
    if "dependencies" in packages.columns:
        declared |= F.coalesce(F.exists(F.map_keys("dependencies"), lambda d: d.rlike(NATIVE_DEPENDENCY)), F.lit(False))
    if "keywords" in packages.columns:
        declared |= F.coalesce(F.exists("keywords", lambda k: k.rlike(NATIVE_WORD)), F.lit(False))
    free = packages.where(declared).select("package").unionByName(files.where(F.col("path").rlike(GYP)).select("package"))
    found = files.where(F.col("path").rlike(NATIVE)).select("package", "path").join(free, "package", "left_anti")
    rows = found.select("package", "path", F.lit("Q-CAP-009").alias("rule_id"), F.lit(0.9).alias("confidence"), F.lit("native file").alias("label"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("excerpt"))
    return top_per(rows, ["package"], MOST_NATIVE, F.asc("path")).select(rows.columns)


def file_signals(files: DataFrame) -> DataFrame:
    """Signals of file texts: patterns, imports, long random literals, encoded runs, hidden characters, packed lines, and what ``scripts.signals`` tells of script files. Those of ``native_signals`` need the packages too."""
    text = F.col("text")
    names = F.transform(F.regexp_extract_all("text", F.lit(IMPORT), 1), lambda m: F.regexp_replace(m, "^node:", ""))
    imports = [F.when(F.arrays_overlap(names, F.array(*map(F.lit, mods))), F.struct(F.lit(r).alias("rule_id"), F.lit(0.95 if r == "Q-CAP-001" else 0.9).alias("confidence"), F.lit("import").alias("label"), F.lit(1).alias("position"))) for r, mods in MODULES.items()]
    literals = F.slice(F.filter(F.regexp_extract_all("text", F.lit(QUOTED), 2), lambda s: F.length(s) >= LITERAL), 1, LITERALS)
    bits = F.array_max(F.transform(literals, entropy))
    runs = F.array_max(F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/=]{256,}|(?:0x)?[0-9a-fA-F]{256,}"), 0), F.length))
    lines = F.length(text) / F.size(F.split(text, "\n"))
    packed = (F.length(text) >= PACKED_BYTES) & (lines > PACKED_LINE) & ~F.col("path").contains(".min.") & ~F.contains(text, F.lit("sourceMappingURL="))
    one = lambda test, rule, confidence, label: F.when(test, F.struct(F.lit(rule).alias("rule_id"), confidence.alias("confidence"), F.lit(label).alias("label"), F.lit(1).alias("position")))
    others = [
        one(bits >= BITS, "Q-OBF-001", F.when(bits >= 5.9, 0.85).otherwise(0.6), "random literal"), one(runs >= RUN, "Q-OBF-002", F.when(runs >= 16 * RUN, 0.85).otherwise(0.65), "encoded run"),
        one(F.regexp_count("text", F.lit(r"_0x[0-9a-f]{4,}")) >= 10, "Q-OBF-004", F.lit(0.9), "generated names"), one(F.regexp_count("text", F.lit(r"[​-‍⁠﻿­]")) >= 3, "Q-OBF-005", F.lit(0.7), "zero width"),
        one(packed, "Q-OBF-006", F.lit(0.6), "packed"),
    ]
    hits = F.concat(_found(text, FILE, F.lit(1.0)), F.array_compact(F.array(*imports, *others)))
    scanned = files.where("text is not null").select("package", "path", "text", F.explode(hits).alias("h"))
    confidence = F.when((F.col("h.label") == "direction") & F.col("path").rlike(PROSE), IN_PROSE).otherwise(F.col("h.confidence")).alias("confidence")
    found = scanned.select("package", "path", "h.rule_id", confidence, "h.label", line_of(text, F.col("h.position")).alias("line"), excerpt(text, F.col("h.position")).alias("excerpt"))
    # A packed file with a source map beside it is nothing to report.
    maps = files.where(F.endswith("path", F.lit(".map"))).select("package", F.expr("substring(path, 1, length(path) - 4)").alias("path"), F.lit("Q-OBF-006").alias("rule_id"))
    return found.join(maps, ["package", "path", "rule_id"], "left_anti").select(found.columns).unionByName(scripts.signals(scripts.facts(files)))


def dense_signals(packages: DataFrame, signals: DataFrame, rules: DataFrame) -> DataFrame:
    """Each package and rule, fired or not: greatest confidence and number of findings; rules switched off are skipped."""
    sums = signals.groupBy("package", "rule_id").agg(F.max("confidence").alias("confidence"), F.count("*").alias("findings"))
    grid = packages.select("package").distinct().crossJoin(F.broadcast(rules.select("rule_id", "family", "enabled")))  # 41 rules
    rows = grid.join(sums, ["package", "rule_id"], "left")
    fired = F.col("findings").isNotNull() & F.col("enabled")
    return rows.select("package", "rule_id", "family", fired.alias("fired"), F.when(fired, F.col("confidence")).otherwise(0.0).alias("confidence"), F.when(~F.col("enabled"), "NOT_APPLICABLE").alias("skipped"), F.coalesce("findings", F.lit(0)).alias("findings"))


def evidence(signals: DataFrame) -> DataFrame:
    """The first findings of each package and rule."""
    return top_per(signals, ["package", "rule_id"], KEPT, F.asc("path"), F.asc("line"), F.asc("label"))
