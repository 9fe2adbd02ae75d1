"""Lock files of JavaScript packages as rows of entries and edges."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.core import record_batches

ROWS = "file string, format string, kind string, name string, version string, child string"
#: The blocks that name dependencies.
BLOCKS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies", "requires")


def read_json(text: str) -> tuple[str, list[tuple]]:
    doc = json.loads(text)
    if not isinstance(doc, dict):
        return "unknown", []
    rows = []
    if isinstance(doc.get("packages"), dict):
        for path, entry in doc["packages"].items():
            if not isinstance(entry, dict):
                continue
            name = entry.get("name") or path.rpartition("node_modules/")[2]
            if path:
                rows.append(("entry", name, entry.get("version"), None))
            for block in BLOCKS:
                for child in entry.get(block) or {}:
                    rows.append(("edge" if path else "root", name if path else None, None, child))
        return f"package-lock v{doc.get('lockfileVersion', 2)}", rows
    if not isinstance(doc.get("dependencies"), dict):
        return "unknown", []
    waiting = list(doc["dependencies"].items())
    rows += [("root", None, None, name) for name in doc["dependencies"]]
    while waiting:
        name, entry = waiting.pop()
        if isinstance(entry, dict):
            rows.append(("entry", name, entry.get("version"), None))
            rows += [("edge", name, None, child) for child in entry.get("requires") or {}] if isinstance(entry.get("requires"), dict) else []
            waiting += (entry.get("dependencies") or {}).items()
    return "package-lock v1", rows


def read_yarn(text: str) -> tuple[str, list[tuple]]:
    rows, names, inside = [], [], False
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        if not line.startswith(" "):
            names = sorted({re.sub(r"(.)@.*$", r"\1", x.strip().strip('"')) for x in line.rstrip(":").split(",")})
            inside = False
        elif found := re.match(r'  version:? "?([^"\s]+)"?', line):
            rows += [("entry", name, found[1], None) for name in names]
        elif re.match(r"  (?:optionalD|d)ependencies:", line):
            inside = True
        elif inside and (found := re.match(r'    "?((?:@[^/\s"]+/)?[^\s"@]+)"?', line)):
            rows += [("edge", name, None, found[1]) for name in names]
        else:
            inside = False
    return "yarn", rows


def parse(text: str | None) -> tuple[str, list[tuple]]:
    """(format, rows); malformed text is of unknown format and has no rows."""
    try:
        if text and text.lstrip().startswith("{"):
            return read_json(text)
        return read_yarn(text) if text and "yarn lockfile" in text[:200] else ("unknown", [])
    except (ValueError, AttributeError, TypeError):
        return "unknown", []


def parsed(files: Iterable[tuple[str, str | None]]) -> Iterator[tuple]:
    """The rows of one file after the other; no more than one file's are held."""
    for file, text in files:
        kind, rows = parse(text)
        for row in rows or [("none", None, None, None)]:
            yield file, kind, *row


def read(files: DataFrame) -> DataFrame:
    """Entries, edges and roots of (file, text) rows; each file without any gives one row of kind ``none``."""

    def each(batches: Iterator) -> Iterator:
        return record_batches(parsed((f.as_py(), t.as_py()) for batch in batches for f, t in zip(*batch.columns)), ROWS)

    return files.select("file", "text").mapInArrow(each, ROWS)


def capped(entries: DataFrame, most: int) -> DataFrame:
    """The first ``most`` entries of each file by name and version, with the number found."""
    from quillon.functions.core import top_per

    rows = entries.where("kind = 'entry'").select("file", "name", "version").distinct()
    found = rows.groupBy("file").agg(F.count("*").alias("found"))
    return top_per(rows, ["file"], most, F.asc("name"), F.asc("version")).join(found, "file").withColumn("truncated", F.col("found") > most)
