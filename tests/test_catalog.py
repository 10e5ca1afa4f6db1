"""What a catalogue says of its tables, and what their rows say of that."""

import uuid

import pytest

from millrace.operators import inspect
from millrace.sources import sinks


@pytest.fixture
def base(spark):
    name = f"catalog_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_a_saved_table_has_a_key_that_holds(spark, base):
    rows = spark.createDataFrame([("b", 2), ("a", 1), (None, None), ("a", 1)], "name string, v int")
    for _ in range(2):  # dropped and made again
        sinks.save_table(rows, f"{base}.t", ["name", "v"], bucket="v", buckets=2, sort=["name"])
    assert sorted((r["id"], r["name"]) for r in spark.table(f"{base}.t").collect()) == [(1, None), (2, "a"), (3, "a"), (4, "b")]
    assert [tuple(r) for r in inspect.key_report(spark, [f"{base}.t"]).collect()] == [("t", "id", 4, 0, 0, True)]
    said = {r["column_name"]: r for r in inspect.reflect_columns(spark, [f"{base}.t"]).collect()}
    assert [c for c in said if said[c]["key_place"] == 0] == ["id"]
    assert (said["v"]["bucket_place"], said["name"]["sort_place"], said["id"]["bucket_place"]) == (0, 0, None)
    assert [said[c]["type_name"] for c in ("name", "v", "id")] == ["string", "int", "bigint"]


def test_keys_that_rows_break(spark, base):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (None, "x"), (None, "x"), (2, None)], "a int, b string")
    rows.write.saveAsTable(f"{base}.t")
    rows.limit(0).write.saveAsTable(f"{base}.none")
    inspect.declare_key(spark, f"{base}.t", ["b", "a"])
    inspect.declare_key(spark, f"{base}.none", ["a"])
    assert [tuple(r) for r in inspect.key_report(spark, [f"{base}.t", f"{base}.none"]).collect()] == [("t", "b,a", 6, 3, 1, False), ("none", "a", 0, 0, 0, True)]
    places = {r["column_name"]: r["key_place"] for r in inspect.reflect_columns(spark, [f"{base}.t"]).collect()}
    assert places == {"a": 1, "b": 0}
    for columns in ([], ["c"]):
        with pytest.raises(ValueError):
            inspect.declare_key(spark, f"{base}.t", columns)


def test_tables_without_a_key_are_counted(spark, base):
    spark.range(3).write.saveAsTable(f"{base}.t")
    assert [tuple(r) for r in inspect.key_report(spark, [f"{base}.t"]).collect()] == [("t", None, 3, None, None, None)]
    assert inspect.reflect_columns(spark, [f"{base}.t"]).first()["key_place"] is None


def test_domains_of_few_values(spark):
    rows = spark.createDataFrame([(i, i % 3, None, "x" if i % 2 else None) for i in range(40)], "many int, few int, none string, one string")
    got = {r["column_name"]: (r["n_values"], r["values"]) for r in inspect.value_domains(rows, rows.columns, 3).collect()}
    assert got == {"many": (40, None), "few": (3, ["0", "1", "2"]), "none": (0, []), "one": (1, ["x"])}
