"""Every query against its SQL, in DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from quillon.plans import registry

#: Without a row in the smallest tables.
RARE = {"encoded_run_scan"}
NAMES = sorted(registry.SQL)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{t}'")
    return con


def value(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else repr(x + 0.0) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, sf_dir, name):
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = sorted(tuple(value(r[c]) for c in columns) for r in got.collect())
    b = sorted(tuple(value(x) for x in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert a == b
    assert a or name in RARE, "an empty result compares nothing"


def test_registry():
    assert set(registry.SQL) <= set(registry.QUERIES) <= set(__spark_entry__.queries())
