"""Safe display, excerpts, repository URLs, digests and addresses."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that hide or reorder text, and control characters.
DECEPTIVE = r"[­؜​-‏‪-‮⁠-⁤⁦-⁩﻿]"
CONTROL = r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F-\u009F]"
#: Networks no connection may reach.
BLOCKED = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
]


def deceptive(text: Column) -> Column:
    return text.rlike(DECEPTIVE)


def safe(text: Column, most: int = 512) -> Column:
    """Without hidden characters, control characters replaced, white space collapsed, cut to a length."""
    shown = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, DECEPTIVE, ""), CONTROL, "�"), r"\s+", " "))
    return F.coalesce(F.when(F.length(shown) > most, F.concat(F.substring(shown, 1, most - 1), F.lit("…"))).otherwise(shown), F.lit(""))


def short_hash(digest: Column, n: int = 12) -> Column:
    return F.substring(F.regexp_replace(digest, "[^a-fA-F0-9]", ""), 1, n)


def line_of(text: Column, position: Column) -> Column:
    """The line, from 1 on, of a 1-based position."""
    head = F.substr(text, F.lit(1), position - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def excerpt(text: Column, position: Column, around: int = 80) -> Column:
    """What stands around a 1-based position, white space collapsed."""
    start = F.greatest(position - around, F.lit(1))
    return F.trim(F.regexp_replace(F.substr(text, start, position - start + around), r"\s+", " "))


def repository_url(value: Column) -> Column:
    """One form for the ways to name a repository; null where it is none."""
    u = F.regexp_replace(F.trim(value), r"^git\+", "")
    u = F.regexp_replace(u, r"^(?:git://|ssh://git@)", "https://")
    u = F.when(u.startswith("git@"), F.concat(F.lit("https://"), F.regexp_replace(F.substr(u, F.lit(5)), r"^([^:]*):", "$1/"))).otherwise(u)
    u = F.when(u.rlike(r"^[\w.-]+/[\w.-]+$"), F.concat(F.lit("https://github.com/"), u)).otherwise(F.regexp_replace(u, "^github:", "https://github.com/"))
    u = F.regexp_replace(F.regexp_replace(u, r"\.git$", ""), r"/+$", "")
    host = F.regexp_extract(u, r"^(?i)(https?://[^/?#]+)", 1)
    rest = F.substr(u, F.length(host) + 1)
    return F.when(host != "", F.concat(F.lower(host), F.when(rest == "", "/").otherwise(rest)))


def integrity(content: Column, expected: Column) -> Column:
    """Do bytes have this digest (``sha512-base64``, ``sha256-``, ``sha1-``, or bare hexadecimal SHA-1)? Others never match."""
    kind, value = F.regexp_extract(expected, r"^(sha(?:1|256|512))-([^-]*)$", 1), F.regexp_extract(expected, r"^(sha(?:1|256|512))-([^-]*)$", 2)
    # base64() breaks long output into lines.
    coded = lambda digest: F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    return F.coalesce(
        F.when(kind == "sha1", coded(F.sha1(content)) == value).when(kind == "sha256", coded(F.sha2(content, 256)) == value).when(kind == "sha512", coded(F.sha2(content, 512)) == value)
        .when(expected.rlike("^[a-fA-F0-9]{40}$"), F.sha1(content) == F.lower(expected)),
        F.lit(False),
    )


def signature(payload: Column, secret: str) -> Column:
    """Hexadecimal HMAC-SHA256."""

    @F.pandas_udf("string")
    def signed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else hmac.new(secret.encode(), x.encode(), hashlib.sha256).hexdigest())

    return signed(payload)


def blocked(address: str | None) -> bool:
    """Would a connection reach private or reserved space? What is no address is not proven safe."""
    try:
        a = ipaddress.ip_address((address or "").split("%")[0])
    except ValueError:
        return True
    if a.version == 6:
        groups = a.packed
        if groups[:12] in (b"\0" * 10 + b"\xff\xff", b"\0" * 12) and a not in (ipaddress.ip_address("::"), ipaddress.ip_address("::1")) or groups[:12] == b"\0\x64\xff\x9b" + b"\0" * 8:
            a = ipaddress.ip_address(groups[12:])
        elif groups[:2] == b"\x20\x02":
            a = ipaddress.ip_address(groups[2:6])
        else:
            return a.is_unspecified or a.is_loopback or groups[:2] == b"\xfe\x80" or groups[0] in (0xFC, 0xFD, 0xFF)
    return any(a in ipaddress.ip_network(n) for n in BLOCKED)


def is_blocked(address: Column) -> Column:
    @F.pandas_udf("boolean")
    def test(rows: pd.Series) -> pd.Series:
        return rows.map(blocked).astype(bool)

    return test(address)


def bucket_key(parts: Column) -> Column:
    """A map's entries as sorted, trimmed, lower-case ``key=value`` text."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(parts), lambda e: F.concat(e["key"], F.lit("="), F.lower(F.trim(e["value"]))))), "&")
