"""Guards, validators, sessions."""

from functools import reduce

from pyspark.sql import functions as F

from ..operators import joins as J
from ..plans import guards as G
from ..plans import memory as M
from .registry import query

# Statements, questions and decisions are made from each document's row: its id picks the shape, its columns fill it.
_RULES = [
    ("SELECT {} FROM customer", ""),
    ("select {} from customer; drop table x", "several statements,forbidden DROP"),
    ("WITH x AS (SELECT 1) SELECT {} FROM x", "not a select,unknown table"),
    ("", "empty,not a select,no from"),
    ("```sql SELECT {} FROM orders```", "fenced,not a select"),
    ("SELECT {} FROM secret JOIN orders", "unknown table"),
    ("SELECT {} FROM orders o, secret s", "unknown table"),
    ('SELECT {} FROM "secret"', "unknown table"),
    ("SELECT {} FROM orders AS o, `customer` JOIN events ON true WHERE a = ' FROM nowhere' -- from there", ""),
    ("SELECT {} FROM orders JOIN main.secret USING (a)", "unknown table"),
]
_ASKS = [
    ("SELECT * FROM events", "everything in {}", "star,year,too broad"),
    ("SELECT value FROM events WHERE district = 'x' ORDER BY ts LIMIT 1", "latest level in France", ""),
    ("SELECT value FROM events WHERE y = {}", "level in Germany in {}", "place"),
    ("SELECT name FROM t ORDER BY v LIMIT 3", "top 5 stations", "top n"),
    ("SELECT value FROM events WHERE a = {}", "current value", "latest"),
    ("SELECT avg(value) FROM events", "average now", ""),
]
_DECISIONS = [
    ("data_query", "HIGH", False, None, "r", ["data_agent"], ["data_agent"], ""),
    ("data_query", "LOW", False, None, "r", ["data_agent"], ["data_agent"], "confidence and clarification"),
    ("mixed_query", "HIGH", False, None, "r", ["data_agent"], ["data_agent"], "mixed"),
    ("general_chat", "HIGH", False, None, "r", [], [], ""),
    ("data_query", "LOW", True, "which?", " ", [], [], "reason"),
    ("prediction_query", "HIGH", False, None, "r", ["data_agent", "knowledge_agent"], ["data_agent"], "order,agent of the intent"),
]


def _expected(found: list[str], name: str = "reasons") -> str:
    """SQL: for each document the entry that its id picks."""
    return f"SELECT doc_id, [{', '.join(f"'{x}'" for x in found)}][CAST(doc_id % {len(found)} AS INT) + 1] AS {name} FROM documents"


def _picked(values: list, kind: str) -> F.Column:
    """The entry that a document's id picks."""
    return F.element_at(F.array(*(F.array(*(F.lit(y) for y in x)).cast(kind) if isinstance(x, list) else F.lit(x).cast(kind) for x in values)), (F.col("doc_id") % len(values)).cast("int") + 1)


@query(_expected([r for _, r in _RULES]))
def validate_sql_rules(t):
    statement = F.replace(_picked([s for s, _ in _RULES], "string"), F.lit("{}"), F.col("lang"))
    return t("documents").select("doc_id", F.array_join(G.sql_reasons(statement, ["customer", "orders", "events"]), ",").alias("reasons"))


@query(_expected([r for *_, r in _ASKS]))
def intent_rules(t):
    year = (1950 + F.col("doc_id") % 100).cast("string")
    statement, ask = (F.replace(_picked([x[i] for x in _ASKS], "string"), F.lit("{}"), year) for i in (0, 1))
    return t("documents").select("doc_id", F.array_join(G.intent_reasons(statement, ask, ["france", "germany"], "unit", ["events"]), ",").alias("reasons"))


@query("SELECT conv_id, turn, NOT (regexp_matches(text, '(?i)\\b(station|river|well)\\b') OR regexp_matches(text, '(?i)\\b(top|bottom|highest|lowest|largest|smallest|most|least|maximum|minimum|max|min|rank|ranking)\\b') OR regexp_matches(text, '(?i)\\b(average|avg|mean|total|sum|count|how\\s+many|number\\s+of|maximum|minimum|max|min)\\b') OR regexp_matches(text, '(?i)\\b(all|every|entire|complete\\s+dataset|list\\s+all|export)\\b')) AS ask_back FROM conversations")
def needs_clarification(t):
    return t("conversations").select("conv_id", "turn", G.needs_clarification(F.col("text"), [], r"(?i)\b(station|river|well)\b").alias("ask_back"))


_FIELDS = (("intent", "string"), ("confidence", "string"), ("requires_clarification", "boolean"), ("clarification_question", "string"), ("reason", "string"), ("agents", "array<string>"), ("execution_order", "array<string>"))


def _decisions(t):
    return t("documents").select("doc_id", *(_picked([d[i] for d in _DECISIONS], kind).alias(name) for i, (name, kind) in enumerate(_FIELDS)))


@query(_expected([d[-1] for d in _DECISIONS]))
def validate_decision(t):
    return _decisions(t).select("doc_id", F.array_join(G.decision_reasons(), ",").alias("reasons"))


@query(f"SELECT doc_id, doc_id % {len(_DECISIONS)} <> {next(i for i, d in enumerate(_DECISIONS) if sorted(d[5]) != sorted(d[6]))} AS ok FROM documents")
def validate_execution_order(t):
    return _decisions(t).select("doc_id", ((F.array_sort("agents") == F.array_sort("execution_order")) & (F.size(F.array_distinct("agents")) == F.size("agents"))).alias("ok"))


def _propose(questions, feedback):
    """Stands for a model: its first answer to every other question isn't a SELECT, and to every third names a wrong table for ever."""
    out = []
    for q, f in zip(questions, feedback, strict=True):
        n = int(q.split()[-1])
        out.append("SELECT a FROM secret" if n % 3 == 0 else "DROP TABLE nation" if n % 2 and not f else "SELECT n_name FROM nation")
    return out


@query("SELECT n_nationkey, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 3 WHEN n_nationkey % 2 = 1 THEN 2 ELSE 1 END AS INT) AS attempt, CASE WHEN n_nationkey % 3 = 0 THEN 'SELECT a FROM secret' ELSE 'SELECT n_name FROM nation' END AS statement, CASE WHEN n_nationkey % 3 = 0 THEN 'unknown table' ELSE '' END AS reasons FROM nation")
def regenerate_sql(t):
    asked = t("nation").select("n_nationkey", F.format_string("name of nation %d", F.col("n_nationkey")).alias("question"))
    out = G.regenerated(asked, _propose, lambda statement, question: G.sql_reasons(statement, ["nation"]))
    return out.select("n_nationkey", "attempt", "statement", F.array_join("reasons", ",").alias("reasons"))


@query("SELECT c_custkey, CAST(unnest(range(1, 4)) AS INT) AS seq, unnest(['data_agent', 'knowledge_agent', 'nobody']) AS agent, unnest(['SUCCESS', CASE WHEN c_acctbal < 0 THEN 'ERROR' ELSE 'SUCCESS' END, 'ERROR']) AS status, unnest([NULL, CASE WHEN c_acctbal < 0 THEN 'ValueError: in debt' END, 'UnknownAgent: nobody']) AS error FROM customer")
def agent_isolation(t):
    def careful(question: str | None) -> str | None:
        if question is not None and float(question) < 0:  # the sign of the text would take in -0.0
            raise ValueError("in debt")
        return question

    order = F.array(F.lit("data_agent"), F.lit("knowledge_agent"), F.lit("nobody"))
    requests = t("customer").select(F.col("c_custkey").alias("request_id"), F.col("c_acctbal").cast("string").alias("question"), order.alias("execution_order"))
    out = G.run_agents(requests, {"data_agent": str, "knowledge_agent": careful})
    return out.select(F.col("request_id").alias("c_custkey"), "seq", "agent", "status", "error")


@query("SELECT user_id, CASE WHEN count(*) = 0 THEN 'NO_AGENTS' WHEN count(*) FILTER (value > 100) = 0 THEN 'SUCCESS' WHEN count(*) FILTER (value > 100) < count(*) THEN 'PARTIAL_SUCCESS' ELSE 'FAILED' END AS status FROM events GROUP BY user_id")
def derive_status(t):
    return t("events").groupBy("user_id").agg(G.status_of(F.count("*"), F.count_if(F.col("value") > 100)).alias("status"))


@query("SELECT event_id, event_type = 'purchase' AS halts FROM events")
def terminal_failure(t):
    return t("events").select("event_id", G.terminal(F.concat(F.col("event_type"), F.lit(": no rows")), ["purchase"]).alias("halts"))


@query("SELECT page_id, '' AS reasons FROM pages")
def validate_contracts(t):
    payload = F.to_json(F.struct(F.lit("SUCCESS").alias("status"), F.col("url").alias("answer")))
    return t("pages").select("page_id", F.array_join(G.contract_reasons(payload, ["status", "answer"], ["SUCCESS", "FAILED"]), ",").alias("reasons"))


@query("SELECT conv_id, max(turn) AS turns, count(*) AS messages, arg_max(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS last_user, arg_max(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN turn END) AS last_assistant FROM conversations GROUP BY conv_id")
def session_snapshot(t):
    return M.session_snapshot(t("conversations"))


def _session_events(t):
    """Each conversation as events of a session; its id decides what else happens to it."""
    c = F.col("conv_id")
    event = lambda rows, seq, op, key=None, value=None: rows.select("conv_id", F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), F.lit(key).cast("string").alias("key"), F.lit(value).cast("string").alias("value"))
    messages = t("conversations")
    sessions = messages.select("conv_id").distinct()
    there = sessions.where(c % 11 != 10)
    parts = [
        messages.select("conv_id", (F.col("turn") * 10 + 5).cast("long").alias("seq"), F.lit("put").alias("op"), F.col("role").alias("key"), F.col("text").alias("value")),
        event(there, 0, "create"), event(sessions, 1, "note", "source", "a"), event(sessions.where(c % 2 == 1), 2, "note", "source", "b"),
        event(there.where(c % 5 == 0), 17, "create"), event(sessions.where(c % 3 == 0), 18, "clear"),
        event(sessions.where(c % 7 == 0), 1_000_000, "delete"), event(sessions.where(c % 14 == 0), 1_000_001, "create"), event(sessions, 2_000_000, "get"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


_SESSIONS = "(SELECT conv_id, conv_id % 11 <> 10 AS e FROM conversations GROUP BY conv_id)"


@query(f"""
SELECT op, status, count(*) AS n FROM (
SELECT 'put' AS op, CASE WHEN conv_id % 11 <> 10 THEN 'STORED' ELSE 'NOT_FOUND' END AS status FROM conversations
UNION ALL SELECT 'create', 'CREATED' FROM {_SESSIONS} WHERE e UNION ALL SELECT 'create', 'CREATED' FROM {_SESSIONS} WHERE conv_id % 14 = 0
UNION ALL SELECT 'create', 'DUPLICATE' FROM {_SESSIONS} WHERE e AND conv_id % 5 = 0
UNION ALL SELECT 'note', CASE WHEN e THEN 'STORED' ELSE 'NOT_FOUND' END FROM {_SESSIONS} UNION ALL SELECT 'note', CASE WHEN e THEN 'STORED' ELSE 'NOT_FOUND' END FROM {_SESSIONS} WHERE conv_id % 2 = 1
UNION ALL SELECT 'clear', CASE WHEN e THEN 'CLEARED' ELSE 'NOT_FOUND' END FROM {_SESSIONS} WHERE conv_id % 3 = 0
UNION ALL SELECT 'delete', CASE WHEN e THEN 'DELETED' ELSE 'NOT_FOUND' END FROM {_SESSIONS} WHERE conv_id % 7 = 0
UNION ALL SELECT 'get', CASE WHEN conv_id % 14 = 0 OR (conv_id % 7 <> 0 AND e) THEN 'FOUND' ELSE 'NOT_FOUND' END FROM {_SESSIONS}) GROUP BY ALL
""")
def session_lifecycle(t):
    return M.replay(_session_events(t)).groupBy("op", "status").agg(F.count("*").alias("n"))


@query("""
SELECT conv_id, count(m.turn) AS messages, arg_max(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS last_user,
CASE WHEN conv_id % 14 = 0 THEN '' WHEN conv_id % 2 = 1 THEN 'source=b' ELSE 'source=a' END AS metadata
FROM (SELECT DISTINCT conv_id FROM conversations) s LEFT JOIN (SELECT * FROM conversations WHERE conv_id % 14 <> 0 AND (conv_id % 3 <> 0 OR turn >= 2)) m USING (conv_id)
WHERE conv_id % 14 = 0 OR (conv_id % 7 <> 0 AND conv_id % 11 <> 10) GROUP BY conv_id
""")
def session_table(t):
    return M.session_table(_session_events(t)).withColumn("metadata", M.render(F.col("metadata")))


@query("SELECT CAST(r_regionkey * 10 + k AS BIGINT) AS id, CASE WHEN k = 0 THEN '{\"n_regionkey\":' || r_regionkey || ',\"n\":' || (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) || '}' END AS row, CASE k WHEN 1 THEN 'rejected: not a select, no from, forbidden DROP' WHEN 2 THEN 'rejected: unknown table' WHEN 3 THEN 'TABLE_OR_VIEW_NOT_FOUND' END AS error FROM region, (VALUES (0), (1), (2), (3)) v(k)")
def read_only_statements(t):
    """Statements that come from rows: they see the table that they may read, and nothing else."""
    key = F.col("r_regionkey").cast("string")
    kinds = F.array(
        F.concat(F.lit("SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey = "), key, F.lit(" GROUP BY n_regionkey;")),
        F.lit("DROP TABLE nation"), F.lit("SELECT c_name FROM customer"), F.lit("SELECT 1 AS x FROM (SELECT 1 FROM nation) y, customer"),
    )
    t("customer").createOrReplaceTempView("customer")  # in the caller's session, out of reach
    asked = t("region").select("r_regionkey", F.posexplode(kinds).alias("k", "statement"))
    return G.run_statements(t.spark, asked.select((F.col("r_regionkey") * 10 + F.col("k")).cast("long").alias("id"), "statement"), {"nation": f"{t.sf_dir}/nation.parquet"})


@query("SELECT conv_id, turn, length(text) <= 4000 AND trim(text) <> '' AS ok FROM conversations")
def request_bounds(t):
    return t("conversations").select("conv_id", "turn", G.question_ok(F.col("text")).alias("ok"))


@query("SELECT doc_id, CAST(n_chars AS BIGINT) AS year, false AS bad FROM documents UNION ALL SELECT doc_id, NULL, true FROM documents")
def parse_year(t):
    good = t("documents").select("doc_id", G.year_of(F.col("n_chars").cast("string")).alias("y"))
    bad = t("documents").select("doc_id", G.year_of(F.lit("next year")).alias("y"))
    return good.unionByName(bad).select("doc_id", "y.*")


@query("SELECT n_nationkey, 'district=' || n_name || '; unit=m' AS rendered FROM nation")
def merge_context(t):
    a = F.create_map(F.lit("unit"), F.lit("mm"), F.lit("district"), F.col("n_name"))
    return t("nation").select("n_nationkey", M.render(M.merge_maps(a, F.create_map(F.lit("unit"), F.lit("m")))).alias("rendered"))


@query("SELECT n_nationkey, 'a=' || n_name AS rendered, 1 AS n_extra FROM nation")
def render_snapshot(t):
    m = F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit(""), F.lit("z"), F.lit("9"))
    parts = M.known_and_extra(m, ["a", "b"])
    return t("nation").select("n_nationkey", M.render(parts["known"]).alias("rendered"), F.size(parts["extra"]).alias("n_extra"))
