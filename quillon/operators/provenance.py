"""A package's files against its source repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.core import half_up

#: Paths that are expected to differ, as regular expressions.
EXPECTED = [
    r"^node_modules/", r"^\.git/", r"^\.github/", r"^\.circleci/", r"^\.vscode/", r"^\.idea/", r"(?:^|/)\.DS_Store$",
    r"^(?:dist|build|lib|es|esm|cjs|umd|out|output|types|typings)/", r"\.min\.(?:js|css|mjs|cjs)$", r"\.map$", r"\.d\.ts$",
    r"^(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|npm-shrinkwrap\.json)$", r"^(?:\.npmignore|\.gitignore|\.gitattributes|\.editorconfig)$",
    r"^(?:\.eslintrc.*|\.prettierrc.*|eslint\.config\..*|prettier\.config\..*)$", r"^(?:tsconfig.*\.json|jsconfig\.json|babel\.config\..*|\.babelrc.*)$",
    r"^(?:rollup|webpack|vite|jest|vitest|karma|gulpfile|Gruntfile)\..*", r"(?i)^(?:CHANGELOG|CONTRIBUTING|CODE_OF_CONDUCT|SECURITY)\.md$",
    r"^(?:test|tests|spec|__tests__|__mocks__|examples?|docs?|benchmark)/", r"\.(?:test|spec)\.[cm]?[jt]sx?$", r"^coverage/", r"^\.changeset/",
]
#: Extensions of executable files.
EXECUTABLE = r"(?i)\.(?:js|mjs|cjs|jsx|ts|mts|cts|tsx|py|sh|bash|ps1|bat|cmd)$"


#: Manifests of a build, sources that are compiled, and more executables, as a share, than an attack adds.
BUILD = r"(?i)^(?:[^/]+/)?(?:tsconfig(?:\..+)?\.json|(?:rollup|webpack|vite|esbuild|babel|gulpfile|Gruntfile|snowpack|parcel|tsup|unbuild|rspack)\.config\.[cm]?[jt]s|gulpfile\.[cm]?js|Makefile|go\.mod|Cargo\.toml|\.babelrc(?:\..+)?|build\.[cm]?[jt]s)$"
COMPILED, DECLARED = r"(?i)\.(?:tsx?|jsx|svelte|vue)$", r"(?i)\.d\.ts$"
INJECTED, BUILT_SHARE = 5, 0.5


def builds(source: DataFrame) -> DataFrame:
    """(package) whose repository (package, path) builds what it publishes."""
    path = F.col("path")
    return source.where(path.rlike(BUILD) | (path.rlike(COMPILED) & ~path.rlike(DECLARED))).select("package").distinct()


def expected(path: Column) -> Column:
    test = path.rlike(EXPECTED[0])
    for pattern in EXPECTED[1:]:
        test = test | path.rlike(pattern)
    return test


def hash_normalised(text: Column) -> Column:
    """SHA-256 of text with line ends made alike."""
    return F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)


def hash_raw(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def compare_trees(packaged: DataFrame, source: DataFrame) -> DataFrame:
    """(package, path, status) of all files of both sides, less those expected to differ. Both have (package, path, hash)."""
    left, right = (x.where(~expected(F.col("path"))) for x in (packaged, source))
    both = left.select("package", "path", F.col("hash").alias("l")).join(right.select("package", "path", F.col("hash").alias("r")), ["package", "path"], "full_outer")
    status = F.when(F.col("r").isNull(), "ONLY_PACKAGED").when(F.col("l").isNull(), "ONLY_SOURCE").when(F.col("l") == F.col("r"), "IDENTICAL").otherwise("MODIFIED")
    return both.select("package", "path", status.alias("status"))


def status_of(trees: DataFrame) -> DataFrame:
    """Numbers of each status, and what they come to."""
    n = {s: F.count_if(F.col("status") == s) for s in ("ONLY_PACKAGED", "ONLY_SOURCE", "MODIFIED", "IDENTICAL")}
    sums = trees.groupBy("package").agg(*(x.alias(s.lower()) for s, x in n.items()), F.count_if((F.col("status") == "ONLY_PACKAGED") & F.col("path").rlike(EXECUTABLE)).alias("executable_only_packaged"))
    compared = F.col("modified") + F.col("identical")
    share = F.when(compared > 0, F.col("modified") / compared)
    verdict = F.when(compared == 0, "NO_TAG").when((F.col("executable_only_packaged") > 0) | (F.col("only_packaged") > 2) | (share > 0.15), "DIVERGENT").otherwise("MATCH")
    return sums.withColumns({"modified_share": half_up(share, 3), "status": verdict})
