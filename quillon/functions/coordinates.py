"""Package coordinates, repositories and links as text; bounded readers of loose JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_coordinate(text: Column) -> Column:
    """struct(name, version) of ``name@version``; version is null where there is none."""
    own = F.regexp_replace(F.trim(text), r"(?i)^npm:", "")
    name, version = F.trim(F.regexp_extract(own, r"^(.+)@([^@]*)$", 1)), F.trim(F.regexp_extract(own, r"^(.+)@([^@]*)$", 2))
    whole = (name != "") & (version != "")
    return F.struct(F.when(whole, name).otherwise(own).alias("name"), F.when(whole, version).alias("version"))


def repository(url: Column) -> Column:
    """struct(host, owner, repo) of a repository's URL; null where it names none."""
    pattern = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?/+([^/?#]+)/+([^/?#]+)"
    part = lambda i: F.regexp_extract(url, pattern, i)
    repo = F.regexp_replace(part(3), r"\.git$", "")
    plain = part(2).rlike(r"^[\w.-]+$") & repo.rlike(r"^[\w.-]+$") & (part(2) != "..") & (repo != "..")
    return F.when(plain, F.struct(F.lower(part(1)).alias("host"), part(2).alias("owner"), repo.alias("repo")))


def looks_encoded(text: Column) -> Column:
    """Whether a literal could be an entry of an obfuscator's table."""
    return (text == "") | text.rlike(r"^[A-Za-z0-9+/=]{16,}$") | text.rlike(r"^[0-9a-fA-F]{8,}$") | ~text.rlike(r"^[\x20-\x7e]*$") | text.rlike(r"^[^a-zA-Z]*$")


def encoded_segment(text: Column) -> Column:
    """Percent-encoded as one segment of a path."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for mark, plain in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(mark), F.lit(plain))
    return out


def decoded_segment(text: Column) -> Column:
    """The text of a segment; one that isn't encoded properly stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def package_link(ecosystem: Column, name: Column, version: Column | None = None) -> Column:
    base = F.concat(F.lit("/packages/"), F.lower(ecosystem), F.lit("/"), encoded_segment(name))
    return base if version is None else F.concat(base, F.lit("/"), encoded_segment(version))


def bounded_text(value: Column, most: int = 2_048) -> Column:
    return F.when(value != "", F.substring(value, 1, most))


def bounded_list(values: Column, items: int = 100, length: int = 128) -> Column:
    """The first texts of an array, cut; nulls and empty ones don't count."""
    return F.slice(F.transform(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x != ""), lambda x: F.substring(x, 1, length)), 1, items)


def bounded_record(values: Column, keys: int = 500) -> Column:
    """The first entries of a map, keys and values cut; null values don't count."""
    entries = F.filter(F.map_entries(F.coalesce(values, F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull())
    cut = F.transform(F.slice(entries, 1, keys), lambda e: F.struct(F.substring(e["key"], 1, 128).alias("key"), F.substring(e["value"], 1, 4_096).alias("value")))
    return F.aggregate(cut, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def similarity(distance: Column, target: Column) -> Column:
    """1 for equal canonical forms, less the more edits there are for the target's length."""
    return F.when(distance == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - distance / F.length(target)))
