"""Package names: look-alikes, canonical forms, scopes, edit distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that pass for ASCII ones, and what they pass for.
LOOK_ALIKES = "аеорсхувмніјѕαορνικυχａｅｏıłơɡ0153"
ASCII_FORMS = "aeopcxybmhijsaopvikuxaeoilogolse"


def folded(name: Column) -> Column:
    return F.translate(F.lower(name), LOOK_ALIKES, ASCII_FORMS)


def stripped(name: Column) -> Column:
    """Without separators."""
    return F.regexp_replace(F.lower(name), r"[-_. ]", "")


def canonical(name: Column) -> Column:
    return F.regexp_replace(folded(name), r"[-_. ]", "")


def has_look_alike(name: Column) -> Column:
    """A non-ASCII character that passes for an ASCII one."""
    return F.translate(name, LOOK_ALIKES[:28], "") != name


def scope(name: Column) -> Column:
    return F.regexp_extract(name, r"^@([^/]+)/", 1)


def bare(name: Column) -> Column:
    return F.regexp_replace(name, r"^@[^/]+/", "")


def distance(a: str, b: str, limit: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours; no part edited twice), or limit + 1 when there are more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, older = row, [i], before
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        if min(row) > limit and min(last) > limit:
            return limit + 1
        before = last
    return min(row[-1], limit + 1)


def edit_distance(a: Column, b: Column, limit: int) -> Column:
    @F.pandas_udf("int")
    def edits(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([distance(x, y, limit) for x, y in zip(left, right)], dtype="int32")

    return edits(a, b)
