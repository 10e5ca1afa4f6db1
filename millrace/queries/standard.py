"""Names, columns, labels and sheets."""

from pyspark.sql import functions as F

from ..operators import grid as G
from ..operators import inspect as I
from ..operators import relational as R
from ..operators import standardize as Z
from .registry import query


@query("SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation FROM customer")
def rename_project(t):
    raw = t("customer").select(F.lit(1).alias("SlNo"), "c_custkey", "c_name", "c_nationkey")
    return Z.tidy_names(raw, {"c_custkey": "id", "c_name": "name", "c_nationkey": "nation"})


@query("SELECT n_nationkey, n_name, 'nation.parquet' AS source_file, 'station' AS measurement_type FROM nation")
def tag_columns(t):
    return t("nation").select("n_nationkey", "n_name").withColumns({"source_file": F.lit("nation.parquet"), "measurement_type": F.lit("station")})


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST(NULL AS VARCHAR) AS block, CAST(NULL AS DOUBLE) AS latitude FROM region")
def conform_schema(t):
    return Z.conform(Z.tidy_names(t("region"), {"r_regionkey": "id", "r_name": "name"}), {"id": "bigint", "name": "string", "block": "string", "latitude": "double"})


@query("SELECT s_name, s_suppkey, s_acctbal, s_nationkey FROM supplier")
def reorder_columns(t):
    return Z.reorder(t("supplier"), ["s_name"], ["s_nationkey"])


@query("SELECT event_id, value AS level_m, 'Telemetry 6 Hourly' AS measurement_type FROM events")
def unpivot_measure(t):
    raw = t("events").select("event_id", F.col("value").alias("Level Telemetry 6 Hourly (meter)"))
    return Z.unpivot_measure(raw, {"event_id"}, "Level", "level_m")


@query("SELECT DISTINCT p_type, coalesce(nullif(trim(regexp_replace(replace(regexp_replace(p_type || ' (unit)', '\\(.*?\\)', '', 'g'), 'STANDARD', ''), '\\s+', ' ', 'g')), ''), p_type || ' (unit)') AS measurement_type FROM part")
def derive_measurement_type(t):
    label = F.concat(F.col("p_type"), F.lit(" (unit)"))
    return t("part").select("p_type").distinct().select("p_type", Z.measurement_type(label, "STANDARD").alias("measurement_type"))


@query("SELECT p_partkey, trim(regexp_replace(replace(regexp_replace(lower(p_name || ' (%) Total'), '[()]', ' ', 'g'), '%', ' percent '), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def snake_case(t):
    return t("part").select("p_partkey", Z.snake_case(F.concat(F.col("p_name"), F.lit(" (%) Total"))).alias("name"))


@query("SELECT p_partkey, CASE WHEN r > 1 THEN p_brand || '_' || CAST(r - 1 AS VARCHAR) ELSE p_brand END AS p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def make_unique(t):
    return Z.make_unique(t("part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")


@query("SELECT r_regionkey, '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\",\"note\":null}' AS evidence FROM region")
def evidence_json(t):
    rows = t("region").select("r_regionkey", "r_name", F.lit(None).cast("string").alias("note"))
    return rows.select("r_regionkey", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("evidence"))


@query("SELECT n_nationkey AS key, n_name AS name FROM nation")
def evidence_view(t):
    view = t("nation").select(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("internal")).alias("record"))
    return view.select("record.key", "record.name")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def column_pruned_scan(t):
    return t("orders").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, trim(regexp_replace(source || '  ' || lang, '\\s+', ' ', 'g')) AS label, trim('  ' || source || ' ') AS stripped, upper(trim(' ' || lang || ' ')) AS key FROM documents")
def clean_label(t):
    return t("documents").select("doc_id", Z.clean_label(F.concat_ws("  ", "source", "lang")).alias("label"), Z.strip(F.concat(F.lit("  "), F.col("source"), F.lit(" "))).alias("stripped"), F.upper(F.trim(F.concat(F.lit(" "), F.col("lang"), F.lit(" ")))).alias("key"))


@query("SELECT n_nationkey, trim('  ' || n_name || ' ') AS n_name FROM nation", name="strip_whitespace")
def strip_whitespace(t):
    return Z.strip_all(t("nation").select("n_nationkey", F.concat(F.lit("  "), F.col("n_name"), F.lit(" ")).alias("n_name")))


@query("SELECT c_custkey, upper(trim(c_mktsegment)) AS key FROM customer")
def normalize_key(t):
    return t("customer").select("c_custkey", F.upper(F.trim("c_mktsegment")).alias("key"))


@query("SELECT event_id, nullif(regexp_extract(strftime(ts, '%d-%m-%Y %H:%M'), '(\\d{4})', 1), '') AS year FROM events")
def extract_year(t):
    return t("events").select("event_id", Z.extract_year(F.date_format("ts", "dd-MM-yyyy HH:mm")).alias("year"))


@query("SELECT doc_id, TRY_CAST(regexp_extract(text, '([0-9.]+)', 1) AS DOUBLE) AS number FROM documents")
def try_cast_real(t):
    return t("documents").select("doc_id", F.regexp_extract("text", "([0-9.]+)", 1).try_cast("double").alias("number"))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, seg ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS filled FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events)")
def ffill_segments(t):
    rows = t("events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("mark"), (F.col("event_type") == "signup").alias("reset"))
    return G.fill_segments(rows, ["user_id"], "event_id", "mark", "reset").select("user_id", "event_id", "filled")


@query("SELECT 'MIXED' AS casing WHERE EXISTS (SELECT 1 FROM customer WHERE c_name <> upper(c_name)) UNION ALL SELECT 'UPPERCASE' WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_name <> upper(c_name))")
def casing_profile(t):
    return I.casing(t("customer"), "c_name")


@query("SELECT * FROM (VALUES ('nation', 3, 25), ('region', 2, 5)) v(table_name, n_columns, n_rows_), LATERAL (SELECT CAST(n_rows_ AS BIGINT) AS n_rows)".replace("SELECT *", "SELECT table_name, CAST(n_columns AS INTEGER) AS n_columns, n_rows", 1))
def catalog_profile(t):
    for name in ("nation", "region"):
        t(name).createOrReplaceTempView(name)
    return I.catalogue_profile(t.spark, ["nation", "region"])


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NOT NULL")
def feature_select(t):
    return t("customer").select("c_custkey", "c_acctbal").where(R.finite("c_acctbal"))
