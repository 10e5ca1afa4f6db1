"""Aggregations."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from ..operators import inspect as I
from ..session import shared_folder
from ..sources import sinks
from .registry import query

MONTH = "date_format(ts, 'dd-MM-yyyy HH:mm')"


@query("SELECT round(avg(value), 4) AS avg_value FROM events")
def agg_avg(t):
    return t("events").agg(F.round(F.avg("value"), 4).alias("avg_value"))


@query("SELECT min(value) AS min_value, max(value) AS max_value FROM events")
def agg_min_max(t):
    return t("events").agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


@query("SELECT round(sum(l_quantity), 2) AS sum_quantity FROM lineitem")
def agg_sum(t):
    return t("lineitem").agg(F.round(F.sum("l_quantity"), 2).alias("sum_quantity"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def agg_count(t):
    return t("events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_count_distinct(t):
    return t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, round(avg(o_totalprice), 4) AS avg_value, count(*) AS n FROM orders GROUP BY 1")
def trend_yearly(t):
    return t("orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("avg_value"), F.count("*").alias("n"))


@query("SELECT substr(strftime(o_orderdate, '%d-%m-%Y %H:%M'), 4, 2) AS month, round(avg(o_totalprice), 4) AS avg_value FROM orders GROUP BY 1")
def trend_monthly(t):
    text = F.date_format("o_orderdate", "dd-MM-yyyy HH:mm")
    return t("orders").groupBy(F.substring(text, 4, 2).alias("month")).agg(F.round(F.avg("o_totalprice"), 4).alias("avg_value"))


@query("SELECT user_id, round(avg(value), 4) AS avg_value, count(*) AS n FROM events GROUP BY user_id")
def agg_by_station(t):
    return t("events").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("avg_value"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS avg_balance FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') GROUP BY 1")
def compare_groups(t):
    return t("customer").where(F.lower("c_mktsegment").isin("building", "machinery")).groupBy("c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("avg_balance"))


@query("SELECT CAST(year(l_shipdate) AS BIGINT) AS year, l_returnflag, round(avg(l_quantity), 4) AS avg_quantity FROM lineitem GROUP BY 1, 2")
def agg_multi_key(t):
    return t("lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year"), "l_returnflag").agg(F.round(F.avg("l_quantity"), 4).alias("avg_quantity"))


@query("SELECT DISTINCT event_type FROM events ORDER BY event_type NULLS FIRST LIMIT 26")
def distinct_values(t):
    return t("events").select("event_type").distinct().orderBy("event_type").limit(26)


@query("SELECT CAST(min(year(o_orderdate)) AS BIGINT) AS first_year, CAST(max(year(o_orderdate)) AS BIGINT) AS last_year FROM orders")
def year_range(t):
    y = F.year("o_orderdate").cast("long")
    return t("orders").agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"))


@query("SELECT CAST(count(*) FILTER (event_id IS NULL) + count(*) FILTER (ts IS NULL) + count(*) FILTER (user_id IS NULL) + count(*) FILTER (event_type IS NULL) + count(*) FILTER (value IS NULL) + count(*) FILTER (props IS NULL) AS BIGINT) AS null_cells FROM events")
def null_cell_count(t):
    return I.null_cells(t("events"))


@query("SELECT (SELECT count(*) FROM orders) AS n_rows, 6 AS n_columns, true AS rows_match, true AS columns_match, true AS nulls_match, 'PASS' AS status")
def load_validation(t):
    path = f"{shared_folder(t.spark)}/orders-{uuid.uuid4().hex}"
    sinks.replace(t("orders"), path, kind="csv")
    loaded = sinks.load_or_empty(t.spark, path, t("orders").schema, "csv")
    return I.reconcile(t("orders"), loaded).withColumn("n_columns", F.col("n_columns").cast("int"))


@query("""SELECT * FROM (VALUES ('o_orderkey', 'INTEGER'), ('o_orderstatus', 'TEXT'), ('o_totalprice', 'REAL'), ('o_orderpriority', 'TEXT')) v(column_name, type_name)""")
def infer_types(t):
    orders = t("orders").select("o_orderkey", "o_orderstatus", F.format_string("%.2f", "o_totalprice").alias("o_totalprice"), "o_orderpriority")
    return I.infer_types(orders.select(*(F.col(c).cast("string").alias(c) for c in orders.columns)))


@query("SELECT upper(trim(n_name)) AS key, round(avg(c_acctbal), 4) AS mean_balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def enrich_district_mean(t):
    own = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy(F.upper(F.trim("n_name")).alias("key")).agg(F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


@query("SELECT o_orderpriority AS key, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS ratio FROM orders GROUP BY 1")
def enrich_ratio(t):
    return t("orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("ratio"))


@query("SELECT o_custkey AS key, CAST(year(o_orderdate) AS BIGINT) AS year, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1, 2")
def enrich_group_year_mean(t):
    return t("orders").groupBy(F.col("o_custkey").alias("key"), F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("SELECT c_nationkey, round(avg(c_acctbal), 4) AS x, round(avg(c_custkey), 4) AS y FROM customer GROUP BY 1")
def centroid(t):
    return t("customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("x"), F.round(F.avg("c_custkey"), 4).alias("y"))


@query("SELECT (SELECT count(*) FROM (SELECT l_returnflag, l_linestatus, l_shipdate FROM lineitem)) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem)) AS rows_after, (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem)) AS duplicates")
def dedup_report(t):
    return I.duplicate_report(t("lineitem").select("l_returnflag", "l_linestatus", "l_shipdate"))


@query("SELECT source, count(*) AS n_rows, count(text) AS n_texts, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source UNION ALL SELECT 'pages' AS source, count(*), count(html), CAST(sum(length(html)) AS BIGINT) FROM pages")
def source_report(t):
    docs = t("documents").groupBy("source").agg(F.count("*").alias("n_rows"), F.count("text").alias("n_texts"), F.sum("n_chars").alias("n_chars"))
    pages = t("pages").agg(F.lit("pages").alias("source"), F.count("*").alias("n_rows"), F.count("html").alias("n_texts"), F.sum(F.length("html").cast("long")).alias("n_chars"))
    return reduce(lambda a, b: a.unionByName(b), (docs, pages))


@query("SELECT count(*) AS documents, count(*) FILTER (coalesce(length(trim(text)), 0) = 0) AS empty_documents, CAST(sum(length(text)) AS BIGINT) AS characters, count(DISTINCT sha256(text)) AS different_texts FROM documents")
def corpus_build_report(t):
    return t("documents").agg(
        F.count("*").alias("documents"),
        F.count_if(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0).alias("empty_documents"),
        F.sum(F.length("text").cast("long")).alias("characters"),
        F.countDistinct(F.sha2("text", 256)).alias("different_texts"),
    )


@query("SELECT count(*) AS runs, count(*) FILTER (event_type = 'purchase') AS succeeded, round(avg(value), 4) AS mean_seconds FROM events")
def benchmark_report(t):
    return t("events").agg(F.count("*").alias("runs"), F.count_if(F.col("event_type") == "purchase").alias("succeeded"), F.round(F.avg("value"), 4).alias("mean_seconds"))
