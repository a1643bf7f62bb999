"""Every registered query with SQL, compared on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from brindle.plans import catalog


@pytest.fixture(scope="module")
def views(small):
    connection = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return connection


def tidy(value):
    return round(value, 6) if isinstance(value, float) else str(value) if value is not None and not isinstance(value, (int, str)) else value


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, small, views, name):
    df = catalog.QUERIES[name](spark, small)
    result = views.execute(catalog.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(repr([tidy(row[names.index(c)]) for c in sorted(names)]) for row in result.fetchall())
    assert sorted(repr([tidy(row[c]) for c in sorted(names)]) for row in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() >= 0
