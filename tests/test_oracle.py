"""Every registered query against its SQL on the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from aislewise.registry import MODULES

duckdb = pytest.importorskip("duckdb")

# Queries of the optional subpackage have their own tests.
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: text for module in MODULES for name, text in module.ORACLE.items()}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLE[name])
    found = [c[0] for c in cursor.description]
    assert columns == sorted(found)
    order = [found.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    actual = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    spark.catalog.clearCache()
    assert actual == expected


def test_entry_is_the_whole_mart(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "date" and len(df.columns) == 36
    assert df.count() > 0
