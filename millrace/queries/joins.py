"""Joins."""

from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import query


def _balance_by_nation(t):
    return t("supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.round(F.avg("s_acctbal"), 4).alias("mean_supplier"))


@query("SELECT c.c_custkey, c.c_nationkey AS nationkey, s.mean_supplier, s.nationkey IS NOT NULL AS matched FROM customer c LEFT JOIN (SELECT s_nationkey AS nationkey, round(avg(s_acctbal), 4) AS mean_supplier FROM supplier GROUP BY 1) s ON c.c_nationkey = s.nationkey")
def validated_left_join(t):
    return J.enrich(t("customer").select("c_custkey", F.col("c_nationkey").alias("nationkey")), _balance_by_nation(t), ["nationkey"]).select("c_custkey", "nationkey", "mean_supplier", "matched")


@query("SELECT count(*) AS n_rows, count(s.nationkey) AS matched_rows, count(*) - count(s.nationkey) AS unmatched_rows, round(100.0::DOUBLE * count(s.nationkey) / count(*), 4) AS match_percent, 100.0 * count(s.nationkey) / count(*) >= 1.0 AS included FROM customer c LEFT JOIN (SELECT DISTINCT s_nationkey AS nationkey FROM supplier) s ON c.c_nationkey = s.nationkey")
def join_match_report(t):
    return J.match_report(J.enrich(t("customer").select("c_custkey", F.col("c_nationkey").alias("nationkey")), _balance_by_nation(t), ["nationkey"]))


@query("SELECT coalesce(a.k, b.k) AS nationkey, a.mean_customer, b.mean_supplier FROM (SELECT c_nationkey AS k, round(avg(c_acctbal), 4) AS mean_customer FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS mean_supplier FROM supplier GROUP BY 1) b ON a.k = b.k")
def reference_outer_join(t):
    own = t("customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.round(F.avg("c_acctbal"), 4).alias("mean_customer"))
    return J.merge_references([own, _balance_by_nation(t)], "nationkey")


@query("SELECT o.o_orderkey, c.c_mktsegment, c.c_custkey IS NOT NULL AS matched FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def reference_lookup(t):
    facts = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.enrich(t("orders").select("o_orderkey", "o_custkey"), facts, ["o_custkey"]).select("o_orderkey", "c_mktsegment", "matched")


@query("SELECT upper(trim(p_brand)) AS key, arg_min(p_type, p_partkey) AS p_type FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def first_wins_lookup(t):
    return J.first_wins(t("part"), J.key_of("p_brand"), "p_type", "p_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def incremental_anti_join(t):
    return J.not_yet(t("customer"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def incremental_semi_join(t):
    return J.already(t("customer"), t("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey").select("c_custkey", "c_name")


@query("SELECT a.year, a.ordered, b.shipped FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, round(sum(o_totalprice), 2) AS ordered FROM orders GROUP BY 1) a JOIN (SELECT CAST(year(l_shipdate) AS BIGINT) AS year, round(sum(l_extendedprice), 2) AS shipped FROM lineitem GROUP BY 1) b ON a.year = b.year")
def cross_table_align(t):
    ordered = t("orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("ordered"))
    shipped = t("lineitem").groupBy(F.year("l_shipdate").cast("long").alias("year")).agg(F.round(F.sum("l_extendedprice"), 2).alias("shipped"))
    return ordered.join(shipped, "year")


@query("SELECT event_type, round(avg(value) FILTER (ts < TIMESTAMP '2024-01-16'), 4) AS actual, round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-16'), 4) AS later, round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-16') - avg(value) FILTER (ts < TIMESTAMP '2024-01-16'), 4) AS difference FROM events GROUP BY 1")
def compare_actual_vs_predicted(t):
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    a, b = F.avg(F.when(early, F.col("value"))), F.avg(F.when(~early, F.col("value")))
    return t("events").groupBy("event_type").agg(F.round(a, 4).alias("actual"), F.round(b, 4).alias("later"), F.round(b - a, 4).alias("difference"))
