"""Cells, identifiers and documents for export."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def csv_cell(value: Column) -> Column:
    """Quoted; text that a spreadsheet would take for a formula is defused."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with guarded cells and a header line each."""
    line = F.concat_ws(",", *(csv_cell(F.col(c)) for c in df.columns))
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def encoded(part: Column) -> Column:
    return F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))


def package_url(kind: Column, name: Column, version: Column) -> Column:
    """``pkg:type/segment/segment@version``, each segment encoded on its own."""
    segments = F.array_join(F.transform(F.split(name, "/"), encoded), "/")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), segments, F.lit("@"), encoded(version))


@F.pandas_udf(StringType())
def decomposed(texts: pd.Series) -> pd.Series:
    """NFKD."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def slug(text: Column) -> Column:
    """Letters and digits with dashes between, at most 40 characters; those of less than three begin with ``org-``. Only texts beyond ASCII leave for Python."""
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), decomposed(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)
    dashed = F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", "-")
    base = F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 40)
    return F.when(F.length(base) >= 3, base).otherwise(F.concat(F.lit("org-"), base))


def identifier(text: Column) -> Column:
    """32-bit FNV-1a of a text's UTF-16 code units below 256, as eight hexadecimal digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    step = lambda h, c: F.pmod(h.bitwiseXOR(c.cast("long")) * 16777619, F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(2166136261).cast("long"), step)), 8, "0"))


def uuid_of(text: Column) -> Column:
    """A text's stable identifier in the form of a UUID: its hash, then its own characters, other than hexadecimal ones as 0."""
    tail = F.rpad(F.regexp_replace(text, "[^0-9a-fA-F]", "0"), 20, "0")
    part = lambda at, n: F.substring(tail, at, n)
    return F.concat(identifier(text), F.lit("-"), part(1, 4), F.lit("-4"), part(5, 3), F.lit("-8"), part(8, 3), F.lit("-"), F.rpad(part(11, 10), 12, "0"))


def sbom(components: DataFrame, key: str) -> DataFrame:
    """(key, document): a CycloneDX 1.5 document of each key's components (name, version).

    One document holds all components of its key, so it is as large as these.
    """
    item = F.struct(F.lit("library").alias("type"), "name", "version", package_url(F.lit("npm"), F.col("name"), F.col("version")).alias("purl"))
    grouped = components.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("components"))
    serial = F.concat(F.lit("urn:uuid:"), uuid_of(F.col(key).cast("string")))
    document = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), serial.alias("serialNumber"), F.lit(1).alias("version"), "components")
    return grouped.select(key, F.to_json(document).alias("document"))
