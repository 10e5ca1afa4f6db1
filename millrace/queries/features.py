"""Features, metrics and models."""

from pyspark.sql import functions as F

from ..operators import features as E
from ..operators import ml as M
from ..operators.boosting import Growth, HistogramBooster
from ..operators.sampling import split
from .registry import query


@query("SELECT event_id, CAST(month(ts) AS BIGINT) AS month FROM events")
def derive_month(t):
    text = F.date_format("ts", "dd-MM-yyyy HH:mm")
    return t("events").select("event_id", F.month(E.parse_time(text)).cast("long").alias("month"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS key FROM lineitem")
def year_key(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", E.year_key(F.col("l_quantity") / 2).alias("key"))


@query("SELECT n_nationkey, '15-' || lpad(CAST(1 + n_nationkey % 12 AS VARCHAR), 2, '0') || '-2026 00:00' AS observation_time FROM nation")
def build_query_row(t):
    return t("nation").select("n_nationkey", F.format_string("15-%02d-%d 00:00", 1 + F.col("n_nationkey") % 12, F.lit(2026)).alias("observation_time"))


@query("SELECT event_id, coalesce(CASE WHEN event_type <> 'click' THEN event_type END, 'unknown') AS kind FROM events")
def impute_constant(t):
    return E.impute_constant(t("events").select("event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind")), ["kind"])


@query("SELECT c_custkey, round(coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, (SELECT quantile_cont(c_acctbal, 0.5) FROM customer WHERE c_acctbal >= 0)), 4) AS balance FROM customer")
def impute_median(t):
    rows = t("customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    return E.impute_median(rows, ["balance"]).withColumn("balance", F.round("balance", 4))


@query("SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal FROM customer")
def standardize(t):
    return E.standardize(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("SELECT DISTINCT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS slot FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def one_hot(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    rows = t("customer").select("c_mktsegment")
    model = Pipeline(stages=[StringIndexer(inputCols=["c_mktsegment"], outputCols=["i"], handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=["i"], outputCols=["v"])]).fit(rows)
    return model.transform(rows).select("c_mktsegment", F.col("i").cast("long").alias("slot")).distinct()


_PAIRS = "SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem"


def _pairs(t):
    return t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


@query(f"SELECT round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2 FROM ({_PAIRS})")
def regression_metrics(t):
    return E.regression_metrics(_pairs(t), "y", "p").select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(f"SELECT round(avg(abs(y - p) / abs(y)) FILTER (abs(y) >= 1), 6) AS mape FROM ({_PAIRS})")
def robust_mape(t):
    return E.regression_metrics(_pairs(t), "y", "p").select(F.round("mape", 6).alias("mape"))


@query("SELECT c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN 'm' ELSE 'mm' END AS unit FROM customer GROUP BY 1, 2")
def resolve_unit(t):
    units = F.create_map(F.lit(0), F.lit("m"))
    return t("customer").select("c_nationkey").distinct().select("c_nationkey", F.coalesce(F.try_element_at(units, F.pmod("c_nationkey", F.lit(2))), F.lit("mm")).alias("unit"))


@query("SELECT p_partkey, 'brand ' || replace(lower(p_brand), '#', ' no ') || ' of size ' || p_size AS description FROM part")
def describe_column(t):
    return t("part").select("p_partkey", F.concat_ws(" ", F.lit("brand"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit(" no ")), F.lit("of size"), F.col("p_size").cast("string")).alias("description"))


TASK = M.Task(target="c_acctbal", numeric=("c_nationkey",), categorical=("c_mktsegment",))


def _trained(t):
    parts = split(t("customer"), "c_custkey")
    train, test = (parts.where(F.col("part") == p).drop("part") for p in ("train", "test"))
    return M.fit_all(TASK, train, M.candidates(TASK)), test


@query()
def ml_candidates(t):
    trained, test = _trained(t)
    return M.compare(TASK, trained, test)


@query()
def boosters(t):
    """Both boosters on a large table, their passes as jobs: errors on rows that they haven't seen."""
    rows = t("lineitem").withColumn("month", F.month("l_shipdate")).withColumn("part", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(5)))
    task = M.Task(target="l_extendedprice", numeric=("l_quantity", "l_discount", "l_tax", "month"), categorical=("l_returnflag", "l_linestatus"))
    growths = {"levelwise": Growth(trees=5, rate=0.3), "leafwise": Growth(trees=5, rate=0.3, leaves=31, ridge=0.0, least_rows=20)}
    models = {k: HistogramBooster(labelCol=task.target, growth=g, one_task=0) for k, g in growths.items()}
    trained = M.fit_all(task, rows.where("part > 0"), models)
    return M.compare(task, trained, rows.where("part = 0")).select("name", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")))


@query()
def predict(t):
    parts = split(t("customer"), "c_custkey")
    trained = M.fit_all(TASK, parts.where("part = 'train'").drop("part"), {"linear": M.candidates(TASK)["linear"]})
    return trained.models["linear"].transform(TASK.prepared(t("customer"))).select("c_custkey", F.round("prediction", 6).alias("prediction"))


@query("SELECT event_id, CASE WHEN value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) THEN 'SUCCESS' ELSE 'NO_PREDICTION' END AS status FROM events")
def prediction_envelope(t):
    return M.envelope(t("events").select("event_id", F.col("value").alias("prediction"))).drop("prediction")
