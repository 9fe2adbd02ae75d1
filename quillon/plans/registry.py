"""Named queries, each with the SQL that says the same, where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.sources.views import VIEW_SQL, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of views (named as its parameters) or of (spark, sf_dir)."""

    def register(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            known = {"spark": spark, "sf_dir": sf_dir}
            return f(*(known[n] if n in known else VIEWS[n](spark, sf_dir) if n in VIEWS else spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)]
            views = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in used)
            SQL[f.__name__] = (f"WITH {views} " if views else "") + f"SELECT * FROM ({sql}) q"
        return f

    return register
