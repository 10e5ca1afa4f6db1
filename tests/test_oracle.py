"""Every query with SQL gives what DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from millrace import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for t in TABLES:
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return "[" + ",".join(map(plain, x)) + "]" if isinstance(x, list) else repr(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in map(tuple, rows))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    other = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(other.columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
