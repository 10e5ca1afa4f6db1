"""Checks of statements, questions, decisions and answers, each a column expression over rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fixed

#: A database without tables, in which guarded statements run.
EMPTY = "millrace_guard"

# Words that make a statement unsafe.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "ATTACH", "DETACH", "PRAGMA", "VACUUM", "REPLACE")

# Words in questions.
LATEST = r"(?i)\b(latest|current|present|recent|newest|most\s+recent|as\s+of\s+now|right\s+now|today|now)\b"
TOP_N = r"(?i)\b(?:top|bottom|highest|lowest|largest|smallest)\s+(\d+)\b"
RANK = r"(?i)\b(top|bottom|highest|lowest|largest|smallest|most|least|maximum|minimum|max|min|rank|ranking)\b"
TOTAL = r"(?i)\b(average|avg|mean|total|sum|count|how\s+many|number\s+of|maximum|minimum|max|min)\b"
EVERYTHING = r"(?i)\b(all|every|entire|complete\s+dataset|list\s+all|export)\b"
YEAR = r"\b(?:19\d{2}|20\d{2})\b"

# Shapes in statements.
SQL_TOTAL = r"(?i)\b(count|sum|avg|min|max)\s*\(|\bgroup\s+by\b"
LIMIT = r"(?i)\blimit\s+(\d+)\b"
STAR = r"(?i)\bselect\s+\*\s+from\b"
_NAME = r'(?:[\w.]++|"[^"]*+"|`[^`]*+`|\[[^\]]*+\])++'
_ITEM = rf"{_NAME}(?:\s++(?:as\s++)?{_NAME})?"
#: After each FROM and JOIN, the names that commas part, with their aliases; they are looked at and not used up.
TABLES = rf"(?i)\b(?:from|join)\b\s*+(?=({_ITEM}(?:\s*+,\s*+{_ITEM})*))"

# Intents, the agent of those that have one, confidence levels, agents.
INTENT_AGENT = {"data_query": "data_agent", "knowledge_query": "knowledge_agent", "prediction_query": "prediction_agent"}
INTENTS = ("data_query", "knowledge_query", "prediction_query", "system_information", "mixed_query", "general_chat", "out_of_scope")
OUT_OF_DOMAIN = ("general_chat", "out_of_scope")
CONFIDENCE = ("HIGH", "MEDIUM", "LOW")
AGENTS = ("data_agent", "knowledge_agent", "prediction_agent")


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(why)) for test, why in pairs)), lambda x: x.isNotNull())


def tables_of(sql: Column) -> Column:
    """array<string>: names after FROM and JOIN, each of a list, lower case and without quotes; literals and comments are no place for names.
    A name after a subquery's comma is left to ``run_read_only``."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(sql, F.lit("")), r"(?s)/\*.*?\*/|--[^\n]*", " "), r"'(?:[^']|'')*+'", "''")
    items = F.flatten(F.transform(F.regexp_extract_all(bare, F.lit(TABLES), F.lit(1)), lambda x: F.split(x, ",")))
    return F.transform(items, lambda x: F.lower(F.regexp_replace(F.regexp_extract(F.trim(x), rf"^({_NAME})", 1), r'[`"\[\]]', "")))


def sql_reasons(sql: Column, tables: list[str]) -> Column:
    """array<string>: every reason against a statement; empty if it may run."""
    text = F.trim(F.coalesce(sql, F.lit("")))
    unknown = F.array_except(tables_of(text), F.array(*(F.lit(x) for x in tables)))
    return _reasons(
        (text == "", "empty"),
        (text.contains("```"), "fenced"),
        (text.startswith("{") | text.startswith("["), "json"),
        (~text.rlike(r"(?i)^select\b"), "not a select"),
        (~text.rlike(r"(?i)\bfrom\b"), "no from"),
        (F.regexp_replace(text, r";\s*$", "").contains(";"), "several statements"),
        *((text.rlike(rf"(?i)\b{w}\b"), f"forbidden {w}") for w in FORBIDDEN),
        (F.size(unknown) > 0, "unknown table"),
    )


class Rejected(ValueError):
    """A statement that may not run."""


def run_read_only(spark: SparkSession, sql: str, tables: dict[str, str]) -> DataFrame:
    """Runs a statement that passes ``sql_reasons``, in a session of its own that sees nothing but views of ``tables`` (name to Parquet path).
    What the patterns overlook, Spark's analysis doesn't find there."""
    why = spark.range(1).select(sql_reasons(F.lit(sql), list(tables)).alias("why")).first()["why"]
    if why:
        raise Rejected(", ".join(why))
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    own.sql(f"CREATE DATABASE IF NOT EXISTS {EMPTY}")
    own.catalog.setCurrentDatabase(EMPTY)
    for name, path in tables.items():
        own.read.parquet(path).createOrReplaceTempView(name)
    return own.sql(sql.strip().rstrip(";"))


def run_statements(spark: SparkSession, statements: DataFrame, tables: dict[str, str], most: int = 200) -> DataFrame:
    """id, row (JSON), error: the result rows of each of ``statements`` (id, statement), run as ``run_read_only`` does, or one row with the
    reason why it didn't run. Statements reach the driver, more than ``most`` are refused; their results don't."""
    asked = statements.select("id", "statement").orderBy("id").limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} statements")
    found = spark.createDataFrame([], "id long, row string, error string")
    for r in asked:
        try:
            rows = run_read_only(spark, r["statement"], tables)
            own = rows.select(F.lit(r["id"]).cast("long").alias("id"), F.to_json(F.struct("*")).alias("row"), F.lit(None).cast("string").alias("error"))
        except Rejected as e:
            own = spark.createDataFrame([(r["id"], None, f"rejected: {e}")], found.schema)
        except AnalysisException as e:
            own = spark.createDataFrame([(r["id"], None, e.getCondition())], found.schema)
        found = found.unionByName(own)
    return found


def regenerated(asked: DataFrame, generate: Callable[[list[str], list[str | None]], list[str | None]], check: Callable[[Column, Column], Column], attempts: int = 3) -> DataFrame:
    """statement, attempt, reasons beside the columns of ``asked`` (with ``question``). ``generate`` makes statements from questions and what
    was wrong before; ``check`` gives the reasons against a statement. Rows with reasons are tried again, at most ``attempts`` times."""

    @F.pandas_udf("string")
    def propose(questions: pd.Series, feedback: pd.Series) -> pd.Series:
        return pd.Series(generate(questions.tolist(), [None if f is None or f != f else f for f in feedback]), index=questions.index, dtype=object)

    todo, done = asked.withColumn("reasons", F.lit(None).cast("array<string>")), None
    for attempt in range(1, attempts + 1):
        feedback = F.concat(F.lit("The last statement was invalid: "), F.array_join("reasons", ", "), F.lit(". Give one correct SELECT."))
        tried = todo.withColumn("statement", F.trim(propose(F.col("question"), feedback))).withColumn("attempt", F.lit(attempt))
        tried = fixed(tried.withColumn("reasons", check(F.col("statement"), F.col("question"))))
        ready = tried if attempt == attempts else tried.where(F.size("reasons") == 0)
        done = ready if done is None else done.unionByName(ready)
        todo = tried.where(F.size("reasons") > 0).drop("statement", "attempt")
    return done


def run_agents(requests: DataFrame, agents: dict[str, Callable[[str], str]]) -> DataFrame:
    """request_id, seq, agent, status, payload, error, seconds: a row for each agent in the ``execution_order`` of each of ``requests``
    (request_id, question, execution_order). An agent that is unknown or fails has a row with its error and harms no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for request, question, order in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for seq, name in enumerate(order or (), 1):
                    began, payload, error = time.perf_counter(), None, None
                    if name not in agents:
                        error = f"UnknownAgent: {name}"
                    else:
                        try:
                            payload = agents[name](question)
                        except Exception as e:  # noqa: BLE001 - any agent may fail, the error is its result
                            error = f"{type(e).__name__}: {e}"
                    out.append({"request_id": request, "seq": seq, "agent": name, "status": "ERROR" if error else "SUCCESS", "payload": payload, "error": error, "seconds": time.perf_counter() - began})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("request_id", pa.int64()), ("seq", pa.int32()), ("agent", pa.string()), ("status", pa.string()), ("payload", pa.string()), ("error", pa.string()), ("seconds", pa.float64())]))

    return requests.select(F.col("request_id").cast("long").alias("request_id"), "question", "execution_order").mapInArrow(run, "request_id long, seq int, agent string, status string, payload string, error string, seconds double")


def intent_reasons(sql: Column, question: Column, places: list[str], units: str, large: list[str]) -> Column:
    """array<string>: rules by which a statement doesn't answer its question. ``units``: the word for the finer place unit."""
    text, ask = F.trim(F.coalesce(sql, F.lit(""))), F.coalesce(question, F.lit(""))
    years = F.regexp_extract_all(ask, F.lit(YEAR), F.lit(0))
    total, limit = text.rlike(SQL_TOTAL), F.nullif(F.regexp_extract(text, LIMIT, 1), F.lit(""))
    wanted = F.nullif(F.regexp_extract(ask, TOP_N, 1), F.lit(""))
    named = F.lit(False)
    for p in places:
        named = named | F.lower(ask).rlike(rf"(?<![a-z]){p}(?![a-z])")
    big = F.arrays_overlap(tables_of(text), F.array(*(F.lit(x) for x in large)))
    unit = rf"(?i)\b{units}\b"
    return _reasons(
        (text.rlike(STAR), "star"),
        (F.exists(years, lambda y: ~text.contains(y)), "year"),
        (named & ~text.rlike(r"(?i)\bdistrict\b"), "place"),
        (ask.rlike(unit) & ~text.rlike(unit), "unit"),
        (ask.rlike(LATEST) & (F.size(years) == 0) & ~total & ~F.coalesce(limit == "1", F.lit(False)), "latest"),
        (wanted.isNotNull() & ~F.coalesce(limit == wanted, F.lit(False)), "top n"),
        (big & ~text.rlike(r"(?i)\bwhere\b") & ~total & limit.isNull(), "too broad"),
    )


def needs_clarification(question: Column, places: list[str], hints: str) -> Column:
    ask = F.coalesce(question, F.lit(""))
    named = F.lit(False)
    for p in places:
        named = named | F.lower(ask).rlike(rf"(?<![a-z]){p}(?![a-z])")
    return ~(named | ask.rlike(hints) | ask.rlike(RANK) | ask.rlike(TOTAL) | ask.rlike(EVERYTHING))


def decision_reasons() -> Column:
    """array<string> over intent, confidence, requires_clarification, clarification_question, reason, agents, execution_order."""
    intent, confidence, clarify = F.col("intent"), F.col("confidence"), F.col("requires_clarification")
    question, agents, order = F.col("clarification_question"), F.coalesce("agents", F.array().cast("array<string>")), F.coalesce("execution_order", F.array().cast("array<string>"))
    away = intent.isin(*OUT_OF_DOMAIN)
    known = F.array(*(F.lit(a) for a in AGENTS))
    sole = F.try_element_at(F.create_map(*(F.lit(x) for kv in INTENT_AGENT.items() for x in kv)), intent)
    return _reasons(
        (intent.isNull() | ~intent.isin(*INTENTS), "intent"),
        (confidence.isNull() | ~confidence.isin(*CONFIDENCE), "confidence"),
        (clarify.isNull(), "clarification flag"),
        (F.col("reason").isNull() | (F.trim("reason") == ""), "reason"),
        (away & (clarify | question.isNotNull() | (confidence == "LOW")), "out of domain"),
        (~away & (F.size(F.array_except(F.concat(agents, order), known)) > 0), "unknown agent"),
        (~away & (F.array_sort(agents) != F.array_sort(order)), "order"),
        (~away & (F.size(F.array_distinct(agents)) != F.size(agents)), "repeated agent"),
        (~away & clarify & ((F.size(agents) > 0) | question.isNull() | (F.trim(question) == "")), "clarification"),
        (~away & ~clarify & (question.isNotNull() | (F.size(agents) == 0)), "no clarification"),
        (~away & ((confidence == "LOW") != clarify), "confidence and clarification"),
        (~away & ~clarify & (intent == "mixed_query") & (F.size(agents) < 2), "mixed"),
        (~away & ~clarify & sole.isNotNull() & ((F.size(agents) != 1) | ~F.array_contains(agents, sole)), "agent of the intent"),
    )


def status_of(executed: Column, failed: Column) -> Column:
    """From counts of agents: none ran, none failed, some failed, all failed."""
    return F.when(executed == 0, "NO_AGENTS").when(failed == 0, "SUCCESS").when(failed < executed, "PARTIAL_SUCCESS").otherwise("FAILED")


def terminal(error: Column, kinds: list[str]) -> Column:
    return F.coalesce(F.trim(F.split(error, ":")[0]).isin(kinds), F.lit(False))


def contract_reasons(payload: Column, keys: list[str], statuses: list[str]) -> Column:
    """array<string>: how a JSON answer breaks its contract: exactly ``keys``, a known status, nothing blank."""
    names = F.json_object_keys(payload)
    return _reasons(
        (names.isNull() | (F.array_sort(names) != F.array_sort(F.array(*(F.lit(k) for k in keys)))), "keys"),
        (~F.coalesce(F.get_json_object(payload, "$.status").isin(statuses), F.lit(False)), "status"),
        *((F.trim(F.coalesce(F.get_json_object(payload, f"$.{k}"), F.lit(""))) == "", f"blank {k}") for k in keys),
    )


def question_ok(c: Column, most: int = 4000) -> Column:
    return F.coalesce((F.length(c) <= most) & (F.trim(c) != ""), F.lit(False))


def year_of(c: Column) -> Column:
    """struct(year, bad): an optional year given as text; anything but digits is bad."""
    t = F.trim(c)
    return F.struct(t.try_cast("long").alias("year"), F.coalesce((t != "") & ~t.rlike(r"^\d+$"), F.lit(False)).alias("bad"))
