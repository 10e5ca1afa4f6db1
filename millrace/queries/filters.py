"""Filters and predicates."""

from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import query


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(trim(c_mktsegment)) = 'building'")
def filter_nocase_eq(t):
    return t("customer").where(R.same_nocase("c_mktsegment", "Building")).select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT n_nationkey, n_name FROM nation WHERE lower(trim(n_name)) IN ('nation_1', 'nation_3', 'france', 'germany', 'brazil')")
def filter_in_list(t):
    return t("nation").where(R.in_nocase("n_name", ["NATION_1", "nation_3", "France", "GERMANY", "Brazil"])).select("n_nationkey", "n_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%1%'")
def filter_ilike(t):
    return t("part").where(R.contains_nocase("p_name", "1")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1995")
def filter_year(t):
    # a range over the column itself reaches the scan, year() would not
    day = F.col("o_orderdate")
    return t("orders").where((day >= F.lit("1995-01-01").cast("timestamp")) & (day < F.lit("1996-01-01").cast("timestamp"))).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, value FROM events WHERE user_id BETWEEN 10 AND 40")
def filter_between(t):
    return t("events").where(F.col("user_id").between(10, 40)).select("event_id", "value")


@query("SELECT o_orderkey, concat(CAST(year(o_orderdate) AS VARCHAR), '-', CAST(year(o_orderdate) + 1 AS VARCHAR)) AS period FROM orders WHERE concat(CAST(year(o_orderdate) AS VARCHAR), '-', CAST(year(o_orderdate) + 1 AS VARCHAR)) = '1996-1997'")
def filter_period(t):
    y = F.year("o_orderdate")
    period = F.concat(y.cast("string"), F.lit("-"), (y + 1).cast("string"))
    return t("orders").select("o_orderkey", period.alias("period")).where("period = '1996-1997'")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def latest_period_filter(t):
    orders = t("orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    return R.at_maximum(orders, "y").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, props FROM events WHERE props IS NOT NULL")
def filter_not_null(t):
    return t("events").where("props is not null").select("event_id", "props")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03")
def filter_threshold(t):
    return t("lineitem").where((F.col("l_quantity") > 45) & (F.col("l_discount") < 0.03)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE lower(trim(o_orderpriority)) = '1-urgent'")
def filter_category(t):
    return t("orders").where(R.same_nocase("o_orderpriority", "1-URGENT")).select("o_orderkey", "o_orderpriority")


@query("SELECT doc_id, lang FROM documents WHERE regexp_full_match(trim(substr(text, 1, 1)), '[0-9]+') OR regexp_full_match(CAST(doc_id AS VARCHAR), '\\s*\\d+\\s*')")
def drop_aggregate_rows(t):
    # a row counter is a run of digits between blanks; total rows and blank rows have none
    counter = F.col("doc_id").cast("string").rlike(r"^\s*\d+\s*$")
    return t("documents").where(F.trim(F.substring("text", 1, 1)).rlike("^[0-9]+$") | counter).select("doc_id", "lang")


@query("SELECT doc_id, text IS NOT NULL AS has_text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
def drop_unusable(t):
    return t("documents").dropna(subset=["doc_id", "text", "lang"]).select("doc_id", F.col("text").isNotNull().alias("has_text"))


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value)")
def finite_filter(t):
    return t("events").where(R.finite("value")).select("event_id", "value")


@query("SELECT d.doc_id, g.name FROM documents d JOIN (SELECT DISTINCT lower(trim(w)) AS name FROM (VALUES ('license'), ('apache'), ('mit'), ('reserved')) v(w)) g ON regexp_matches(lower(d.text), '(^|[^a-z])' || g.name || '($|[^a-z])')")
def gazetteer_match(t):
    # the gazetteer is a constant of four names: one pass over the texts, no join
    names = ["license", "apache", "mit", "reserved"]
    found = F.filter(F.array(*(F.when(F.lower("text").rlike(f"(?<![a-z]){n}(?![a-z])"), n) for n in names)), lambda x: x.isNotNull())
    return t("documents").select("doc_id", F.explode(found).alias("name"))
