"""Latest rows, ranks, samples, limits and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import features as E
from ..operators import inspect as I
from ..operators import ml as M
from ..operators import relational as R
from ..operators import sampling as S
from ..operators import standardize as Z
from .registry import query


@query("SELECT event_id, user_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_observation(t):
    return R.latest(t("events").select("event_id", "user_id", "value", "ts"), "ts", "event_id").drop("ts")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1996 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_in_year(t):
    return R.latest(t("orders").where(F.year("o_orderdate") == 1996), "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT event_id, substr(s, 7, 4) || substr(s, 4, 2) || substr(s, 1, 2) || substr(s, 12, 2) || substr(s, 15, 2) AS text_key FROM (SELECT event_id, strftime(ts, '%d-%m-%Y %H:%M') AS s FROM events) ORDER BY text_key DESC, event_id DESC LIMIT 1")
def latest_text_key(t):
    s = F.date_format("ts", "dd-MM-yyyy HH:mm")
    key = F.concat(F.substring(s, 7, 4), F.substring(s, 4, 2), F.substring(s, 1, 2), F.substring(s, 12, 2), F.substring(s, 15, 2))
    return R.latest(t("events").select("event_id", key.alias("text_key")), "text_key", "event_id")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def top_1(t):
    return R.top(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 1)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_n(t):
    return R.top(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10")
def bottom_n(t):
    return R.top(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10, largest=False)


@query("SELECT user_id, round(avg(value), 4) AS avg_value FROM events GROUP BY 1 ORDER BY 2 DESC, 1")
def rank_all(t):
    return t("events").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("avg_value")).orderBy(F.desc("avg_value"), "user_id")


@query("SELECT user_id, round(avg(value), 4) AS avg_value FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def argmax_group(t):
    return R.top(t("events").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("avg_value")), "avg_value", "user_id", 1)


@query("SELECT least(count(*), 201) AS seen_rows, CASE WHEN count(*) > 200 THEN 'REJECT' WHEN count(*) > 50 THEN 'WARN' ELSE 'OK' END AS verdict FROM events")
def row_cap_guard(t):
    return R.cap_report(t("events"))


_GUESSES = {"mean_price": "l_quantity * 1500", "low_price": "l_quantity * 1000", "flat": "36000 + 0 * l_quantity"}


@query("SELECT name, round(score, 4) AS score FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, sqrt(avg((l_extendedprice - {e}) * (l_extendedprice - {e}))) AS score FROM lineitem" for k, e in _GUESSES.items()) + ") ORDER BY score LIMIT 1")
def select_best(t):
    results = [E.regression_metrics(t("lineitem").select("l_extendedprice", F.expr(e).alias("guess")), "l_extendedprice", "guess").select(F.lit(k).alias("name"), "*") for k, e in _GUESSES.items()]
    return M.select_best(Z.union(results)).withColumn("score", F.round("score", 4))


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY md5(CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) || ':42'), l_orderkey * 100 + l_linenumber) AS r FROM lineitem) WHERE r <= 500 ORDER BY md5(CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) || ':42'), l_orderkey * 100 + l_linenumber LIMIT 1500")
def stratified_sample(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"))
    return S.stratified(rows, ["l_returnflag"], 1500, "row_id").drop("row_id")


@query("SELECT event_id, user_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id LIMIT 300")
def deterministic_sample(t):
    return S.sample_rows(t("events").select("event_id", "user_id"), 300, "event_id")


@query("SELECT event_id, CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':42'), 1, 8) AS BIGINT) < CAST(0.8 * 4294967296 AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM events")
def train_test_split(t):
    return S.split(t("events").select("event_id"), "event_id")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS r FROM conversations) WHERE r <= 6")
def recent_messages(t):
    return S.recent(t("conversations").select("conv_id", "turn", "role"), "conv_id", ["turn", "role"], 6)


@query("SELECT conv_id, role, max(turn) AS last_turn, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id, role")
def last_message_by_role(t):
    return t("conversations").groupBy("conv_id", "role").agg(F.max("turn").alias("last_turn"), F.max_by("text", "turn").alias("last_text"))


@query("SELECT conv_id, turn, CAST(count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS BIGINT) AS user_turn FROM conversations")
def session_turns(t):
    running = F.sum((F.col("role") == "user").cast("long")).over(Window.partitionBy("conv_id").orderBy("turn", "role").rowsBetween(Window.unboundedPreceding, 0))
    return t("conversations").select("conv_id", "turn", running.alias("user_turn"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) AS id FROM customer")
def surrogate_key(t):
    return S.surrogate_key(t("customer").select("c_custkey", "c_name"), ["c_name", "c_custkey"]).select("c_custkey", "id")


@query("SELECT c_custkey AS key, c_acctbal AS balance, NULL AS segment_of_part FROM customer UNION ALL SELECT p_partkey, NULL, p_type FROM part")
def union_by_name(t):
    return Z.union([t("customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")), t("part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("segment_of_part"))])


@query("SELECT s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT c_name, c_acctbal FROM customer")
def union_all(t):
    return Z.union([t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), t("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))])


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def dedup_rows(t):
    return t("lineitem").select("l_returnflag", "l_linestatus", "l_quantity").dropDuplicates()


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_content_hash(t):
    # the first of each content, combined before the shuffle; only hashes move
    docs = t("documents").where("text is not null").select(F.sha2("text", 256).alias("content_hash"), "doc_id")
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT norm, list_sort(list(DISTINCT v)) AS variants FROM (SELECT lower(regexp_replace(v, '[\\s_]+', '', 'g')) AS norm, v FROM (SELECT n_name AS v FROM nation UNION ALL SELECT lower(n_name) FROM nation)) GROUP BY norm HAVING count(DISTINCT v) > 1")
def schema_variants(t):
    names = t("nation").select(F.col("n_name").alias("column_name"))
    return I.schema_variants(names.union(names.select(F.lower("column_name"))))
