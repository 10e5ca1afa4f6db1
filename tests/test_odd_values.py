"""Queries with SQL on values that the given tables don't hold; signs of zeros count."""

import duckdb
import pytest

from millrace import catalogue

ACCOUNTS = "SELECT CAST(row_number() OVER () AS BIGINT) AS c_custkey, v AS c_acctbal FROM (SELECT unnest([-(0.0::DOUBLE), 0.0, NULL, 'nan', 'inf', '-inf', -1e-5, 1e-7, -1e20, -3.25]::DOUBLE[]) AS v)"
NUMBERS = "[[1, 2], [-1e-9, 1], [1e-9, 1], [0, 0], NULL, [], [NULL, 2], [NULL, 0], [NULL, NULL], ['nan'::FLOAT, 1], ['inf'::FLOAT, -1], [1e38, -1e38], [1e-45, -1e-45], [0.6, 0.8], [3]]::FLOAT[][]"
VECTORS = f"SELECT CAST(row_number() OVER () AS BIGINT) AS vec_id, v AS embedding FROM (SELECT unnest({NUMBERS}) AS v)"


def texts(rows):
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("name, table, made", [("agent_isolation", "customer", ACCOUNTS), ("l2_normalize", "embeddings", VECTORS)])
def test_same_as_sql_on_odd_values(spark, tmp_path, name, table, made):
    duck = duckdb.connect()
    duck.sql(f"CREATE TABLE {table} AS {made}")
    duck.sql(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    want = duck.sql(catalogue.oracle_sql()[name])
    df = catalogue.queries()[name](spark, str(tmp_path))
    assert df.columns == want.columns
    assert texts(df.collect()) == texts(want.fetchall())


def test_rounding_as_sql(spark):
    from pyspark.sql import functions as F

    from millrace.functions import vectors as V

    values = [0.0000005, -0.0000005, 0.0000015, -0.0000025, 1.0000005, 0.0078125, -0.0078125, 0.1234565, -0.1234575, -4e-7, 2.5e-6, 123.4567895, -0.0]
    got = [r["r"] for r in spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", V.rounded(F.col("x"), 6).alias("r")).orderBy("i").collect()]
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [x]).fetchone()[0] for x in values]
    assert list(map(repr, got)) == list(map(repr, want))
