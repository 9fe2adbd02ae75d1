"""Documents of package registries (one JSON text a row) as versions, releases and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.core import first_per
from quillon.functions.text import repository_url

#: What names may be, keywords kept, and project links in order of preference.
NPM_NAME = r"^(?:@[a-z0-9~-][a-z0-9._~-]*/)?[a-z0-9~-][a-z0-9._~-]*$"
PYPI_NAME = r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?$"
KEYWORDS = 100
LINKS = ["source", "source code", "repository", "code", "github", "homepage"]

NPM = "name string, `dist-tags` map<string,string>, time map<string,string>, versions map<string, struct<version:string, license:string, description:string, keywords:array<string>, scripts:map<string,string>, dependencies:map<string,string>, repository:struct<url:string>, dist:struct<tarball:string, integrity:string, shasum:string>>>"
PYPI = "info struct<name:string, version:string, keywords:string, license:string, home_page:string, project_urls:map<string,string>>, releases map<string, array<struct<filename:string, packagetype:string, url:string, upload_time_iso_8601:string>>>"


def pypi_name(name):
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def valid(df: DataFrame, ecosystem: str, name: str = "name") -> DataFrame:
    return df.where(F.col(name).rlike(NPM_NAME if ecosystem == "NPM" else PYPI_NAME) & (F.length(name) <= 214))


def npm_releases(documents: DataFrame) -> DataFrame:
    """(name, version, published_at) of documents with a column ``json``; what isn't a time is left out."""
    doc = documents.select(F.from_json("json", NPM).alias("d"))
    rows = doc.select("d.name", F.explode(F.map_entries("d.time")).alias("t")).where(~F.col("t.key").isin("created", "modified"))
    return rows.select("name", F.col("t.key").alias("version"), F.try_to_timestamp("t.value").alias("published_at")).where("published_at is not null")


def npm_versions(documents: DataFrame, downloads: DataFrame | None = None) -> DataFrame:
    """One row for each version: metadata, scripts, archive, tags that point to it; downloads where they are known."""
    doc = documents.select(F.from_json("json", NPM).alias("d"))
    rows = doc.select("d.name", F.col("d.dist-tags").alias("tags"), F.explode(F.map_entries("d.versions")).alias("v"))
    out = rows.select(
        "name", F.col("v.key").alias("version"), F.col("v.value.license").alias("license"), F.col("v.value.description").alias("description"), F.slice("v.value.keywords", 1, KEYWORDS).alias("keywords"),
        F.col("v.value.scripts").alias("scripts"), F.col("v.value.dependencies").alias("dependencies"), repository_url(F.col("v.value.repository.url")).alias("repository"),
        F.col("v.value.dist.tarball").alias("archive"), F.coalesce("v.value.dist.integrity", "v.value.dist.shasum").alias("integrity"),
        F.array_sort(F.map_keys(F.map_filter("tags", lambda _, to: to == F.col("v.key")))).alias("tags"),
    )
    return out if downloads is None else out.join(downloads.select("name", "downloads"), "name", "left")


def resolve(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, wanted, version): an exact version, else the one a tag points to, else null."""
    rows = wanted.join(versions.select("name", "version", "tags"), "name", "left")
    rank = F.when(F.col("version") == F.col("wanted"), 0).when(F.array_contains("tags", F.col("wanted")), 1).otherwise(2)
    best = first_per(rows.withColumn("_rank", rank), ["name", "wanted"], F.col("_rank"), F.col("version"))
    return best.select("name", "wanted", F.when(F.col("_rank") < 2, F.col("version")).alias("version"))


def pypi_releases(documents: DataFrame) -> DataFrame:
    """(name, version, published_at): a release came with its earliest file."""
    doc = documents.select(F.from_json("json", PYPI).alias("d"))
    files = doc.select(pypi_name(F.col("d.info.name")).alias("name"), F.explode(F.map_entries("d.releases")).alias("r")).select("name", F.col("r.key").alias("version"), F.explode("r.value").alias("f"))
    return files.groupBy("name", "version").agg(F.min(F.try_to_timestamp("f.upload_time_iso_8601")).alias("published_at")).where("published_at is not null")


def pypi_packages(documents: DataFrame) -> DataFrame:
    """Name, keywords and repository of each document; links are looked at in order of preference, then any of a known host."""
    doc = documents.select(F.from_json("json", PYPI).alias("d"))
    links = F.map_entries(F.coalesce("d.info.project_urls", F.create_map().cast("map<string,string>")))
    by_name = lambda label: F.get(F.filter(links, lambda e: F.lower(e["key"]) == label), F.lit(0))["value"]
    hosted = F.filter(links, lambda e: e["value"].rlike(r"github\.com|gitlab\.com|bitbucket\.org"))
    url = F.coalesce(*(repository_url(by_name(x)) for x in LINKS), repository_url(F.try_element_at(hosted, F.lit(1))["value"]), repository_url(F.col("d.info.home_page")))
    words = F.filter(F.split("d.info.keywords", r"[,\s]+"), lambda w: w != "")
    return doc.select(pypi_name(F.col("d.info.name")).alias("name"), F.col("d.info.version").alias("version"), F.slice(words, 1, KEYWORDS).alias("keywords"), url.alias("repository"))


def pypi_archives(documents: DataFrame) -> DataFrame:
    """(name, version, filename, url) of each release's source archive: an sdist in tar.gz before any other tar.gz."""
    doc = documents.select(F.from_json("json", PYPI).alias("d"))
    files = doc.select(pypi_name(F.col("d.info.name")).alias("name"), F.explode(F.map_entries("d.releases")).alias("r")).select("name", F.col("r.key").alias("version"), F.explode("r.value").alias("f")).select("name", "version", "f.*").where(F.endswith("filename", F.lit(".tar.gz")))
    return first_per(files, ["name", "version"], F.when(F.col("packagetype") == "sdist", 0).otherwise(1), F.col("filename")).select("name", "version", "filename", "url")


#: What stands before and behind a version in its customary tags, in order of preference.
CUSTOMARY = [("v", ""), ("", ""), ("release-", ""), ("releases/", ""), ("", "-release")]


def resolve_tags(wanted: DataFrame, tags: DataFrame) -> DataFrame:
    """(name, version, tag): the first customary tag of a version that the repository (name, tag) has, else the least one that ends in the version.

    Tags say which versions they may stand for, so one aggregate by name and
    version without its "v" holds all; what is shuffled is a row for each wanted
    version and each candidate, at any size of the tables. Customary tags are made
    again from their rank. Null names, versions and tags give no row.
    """
    tag, last = F.col("tag"), len(CUSTOMARY)
    fits = lambda before, behind: F.startswith(tag, F.lit(before)) & F.endswith(tag, F.lit(behind)) & (F.length(tag) >= len(before + behind))
    inside = lambda before, behind: F.substring(tag, F.lit(len(before) + 1), F.length(tag) - len(before + behind))
    candidate = lambda bare, rank, own: F.struct(bare.alias("bare"), F.lit(rank).cast("tinyint").alias("rank"), own.alias("tag"))
    customary = F.array(*(F.when(fits(*x), candidate(inside(*x), rank, F.lit(None).cast("string"))) for rank, x in enumerate(CUSTOMARY)))
    # The end of a tag behind each separator; a version may itself have separators. "release-" and "releases/" are customary already.
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length("tag"), F.lit(1))), lambda i: F.substring("tag", i, F.lit(1)).isin("@", "-", "/") & ~F.substring("tag", F.lit(1), i).isin("release-", "releases/"))
    ends = F.transform(at, lambda i: candidate(F.substring("tag", i + 1, F.length("tag")), last, tag))
    rows = tags.where("name is not null and tag is not null").select("name", F.explode(F.concat(F.array_compact(customary), ends)).alias("c")).select("name", "c.*")
    # Wanted versions travel with the tags, those with a "v" as -2 and those without as -1.
    v = F.startswith("version", F.lit("v"))
    bare = F.when(v, F.substring("version", F.lit(2), F.length("version"))).otherwise(F.col("version"))
    asked = wanted.where("name is not null and version is not null").select("name", bare.alias("bare"), F.when(v, -2).otherwise(-1).cast("tinyint").alias("rank"), F.lit(None).cast("string").alias("tag"))
    best = F.min(F.when(F.col("rank") >= 0, F.struct("rank", "tag"))).alias("best")
    found = asked.unionByName(rows).groupBy("name", "bare").agg(best, F.bool_or(F.col("rank") == -1).alias("plain"), F.bool_or(F.col("rank") == -2).alias("v")).where("best is not null and (plain or v)")
    made = [F.when(F.col("best.rank") == rank, F.concat(F.lit(before), "bare", F.lit(behind))) for rank, (before, behind) in enumerate(CUSTOMARY)]
    versions = F.array_compact(F.array(F.when(F.col("plain"), F.col("bare")), F.when(F.col("v"), F.concat(F.lit("v"), "bare"))))
    return found.select("name", F.explode(versions).alias("version"), F.coalesce("best.tag", *made).alias("tag"))
