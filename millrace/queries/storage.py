"""Sinks, read back: what a table holds after it was written."""

import uuid
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import inspect as I
from ..operators import ml as M
from ..session import shared_folder
from ..sources import sinks
from .registry import query

_CUSTOMER = ("c_custkey", "c_name", "c_mktsegment")
_SCHEMA = "c_custkey long, c_name string, c_mktsegment string"


def _place(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_sink(t):
    path = _place(t, "csv")
    sinks.replace(t("customer").select(*_CUSTOMER), path, kind="csv")
    return sinks.load_or_empty(t.spark, path, _SCHEMA, "csv")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_nationkey < 3")
def csv_append(t):
    path = _place(t, "parts")
    sinks.replace(t("customer").select(*_CUSTOMER), path, kind="csv")  # an older table, which goes
    rows = t("customer")
    sinks.append_each([rows.where(F.col("c_nationkey") == n).select(*_CUSTOMER) for n in range(3)], path, "csv")
    return sinks.load_or_empty(t.spark, path, _SCHEMA, "csv")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_sink(t):
    schema, path = "n_nationkey long, n_name string, n_regionkey long", _place(t, "manifest")
    rows = t("nation").select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")))
    before = sinks.load_or_empty(t.spark, path, schema, "json")  # nothing is there yet
    sinks.replace(before.unionByName(rows), path, kind="json")
    return sinks.load_or_empty(t.spark, path, schema, "json")


@query("SELECT vec_id AS embedding_id, label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 1000000 + vec_id, label FROM embeddings WHERE vec_id % 2 = 0")
def vector_index_sink(t):
    """Vectors are appended under new ids and loaded again; those that still equal their source count."""
    path, even = _place(t, "index"), t("embeddings").where("vec_id % 2 = 0")
    parts = [even.select((F.col("vec_id") + k).alias("embedding_id"), "embedding", "label") for k in (0, 1_000_000)]
    sinks.append_each(parts, path)
    loaded, source = sinks.load_or_empty(t.spark, path, "embedding_id long, embedding array<float>, label int"), reduce(lambda a, b: a.unionByName(b), parts)
    return loaded.join(source.select("embedding_id", F.col("embedding").alias("own")), "embedding_id").where(F.col("own") == F.col("embedding")).select("embedding_id", "label")


@query("SELECT c_custkey, true AS same FROM customer")
def model_sink(t):
    """A fitted model predicts after it was saved and loaded what it predicted before."""
    rows = t("customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("y"), F.col("c_nationkey").cast("double").alias("x"))
    task, folder = M.effective_task(M.Task("y", ()), rows, ("x", "no_such_column")), _place(t, "model")
    model: PipelineModel = M.fit_all(task, rows, {"linear": M.candidates(task)["linear"]}).models["linear"]
    M.save_model(t.spark, model, folder, {"task": task.target})
    loaded, _ = M.load_model(t.spark, folder)
    predicted = lambda m, name: m.transform(task.prepared(rows)).select("c_custkey", F.col("prediction").alias(name))
    return predicted(model, "a").join(predicted(loaded, "b"), "c_custkey").select("c_custkey", (F.col("a") == F.col("b")).alias("same"))


@query("SELECT r_regionkey, r_name, NULL AS error FROM region UNION ALL SELECT -1, ' ', 'the question is empty'")
def query_vector(t):
    """Each question's vector is the one that chunks get; a blank question is an error."""
    names = t("region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")
    blank = names.agg(F.lit(-1).cast("long").alias("r_regionkey"), F.lit(" ").alias("r_name"))
    asked = V.embed_queries(names.withColumn("asked", F.concat(F.lit(" \n"), "r_name", F.lit("\t"))).unionByName(blank.withColumn("asked", F.col("r_name"))), "asked")
    embedded = V.embed(asked.withColumnRenamed("embedding", "own"), "r_name")
    return embedded.where(F.col("error").isNotNull() | (F.col("own") == F.col("embedding"))).select("r_regionkey", "r_name", "error")


def _warehouse(t) -> list[str]:
    """Customers with a running id, in buckets; orders and nations under keys of their own, the former one that doesn't hold."""
    base, root = f"millrace_{uuid.uuid4().hex}", _place(t, "warehouse")
    t.spark.sql(f"CREATE DATABASE {base} LOCATION '{root}'")
    customers = t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    sinks.save_table(customers, f"{base}.customers", ["c_name", "c_custkey"], bucket="c_nationkey", buckets=4, sort=["c_nationkey", "c_custkey"])
    t("orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.partitionBy("o_orderstatus").saveAsTable(f"{base}.orders")
    t("nation").select("n_nationkey", "n_name").write.saveAsTable(f"{base}.nations")
    I.declare_key(t.spark, f"{base}.orders", ["o_orderstatus", "o_custkey"])
    return [f"{base}.{x}" for x in ("customers", "orders", "nations")]


_REFLECTED = (
    ("customers", "customer", "c_custkey c_name c_nationkey c_acctbal id"),
    ("orders", "orders", "o_orderkey o_custkey o_orderstatus"),
    ("nations", "nation", "n_nationkey n_name"),
)
_USES = "(VALUES ('customers', 'id', 0, NULL, NULL, NULL), ('customers', 'c_nationkey', NULL, NULL, 0, 0), ('customers', 'c_custkey', NULL, NULL, NULL, 1), ('orders', 'o_orderstatus', 0, 0, NULL, NULL), ('orders', 'o_custkey', 1, NULL, NULL, NULL)) u(table_name, column_name, key_place, partition_place, bucket_place, sort_place)"
_OWN = " UNION ALL ".join(f"SELECT '{name}' AS table_name, CAST({i} AS INTEGER) AS position, '{c}' AS column_name, " + (f"(SELECT column_type FROM (DESCRIBE {source}) WHERE column_name = '{c}')" if c != "id" else "'BIGINT'") + " AS kind" for name, source, columns in _REFLECTED for i, c in enumerate(columns.split()))


@query(f"SELECT table_name, position, column_name, CASE kind WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(kind) END AS type_name, true AS nullable, CAST(key_place AS INTEGER) AS key_place, CAST(partition_place AS INTEGER) AS partition_place, CAST(bucket_place AS INTEGER) AS bucket_place, CAST(sort_place AS INTEGER) AS sort_place FROM ({_OWN}) LEFT JOIN {_USES} USING (table_name, column_name)")
def catalog_columns(t):
    return I.reflect_columns(t.spark, _warehouse(t))


@query("SELECT 'customers' AS table_name, 'id' AS key_columns, count(*) AS n_rows, 0 AS n_null, 0 AS n_repeated, true AS is_key FROM customer UNION ALL SELECT 'orders', 'o_orderstatus,o_custkey', count(*), count(*) FILTER (o_orderstatus IS NULL OR o_custkey IS NULL), count(*) FILTER (o_orderstatus IS NOT NULL AND o_custkey IS NOT NULL) - count(DISTINCT (o_orderstatus, o_custkey)) FILTER (o_orderstatus IS NOT NULL AND o_custkey IS NOT NULL), false FROM orders UNION ALL SELECT 'nations', NULL, count(*), NULL, NULL, NULL FROM nation")
def catalog_keys(t):
    return I.key_report(t.spark, _warehouse(t))


_DOMAINS = ("o_orderstatus", "o_orderpriority", "o_custkey")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_values, CASE WHEN count(DISTINCT {c}) <= 25 THEN list_sort(list(DISTINCT CAST({c} AS VARCHAR)) FILTER ({c} IS NOT NULL)) END AS vals FROM orders" for c in _DOMAINS))
def value_domains(t):
    return I.value_domains(t("orders"), list(_DOMAINS), 25).withColumnRenamed("values", "vals")
