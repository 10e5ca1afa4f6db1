"""Sessions as rows: snapshots, merged contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_maps(first: Column, second: Column) -> Column:
    """Keys of both; the second wins."""
    kept = F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def known_and_extra(m: Column, known: list[str]) -> Column:
    """struct(known, extra): entries whose keys are known, and the others."""
    names = F.array(*(F.lit(k) for k in known))
    return F.struct(F.map_filter(m, lambda k, v: F.array_contains(names, k)).alias("known"), F.map_filter(m, lambda k, v: ~F.array_contains(names, k)).alias("extra"))


def render(m: Column) -> Column:
    """Populated fields as lines, sorted by key."""
    full = F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))
    return F.array_join(F.transform(F.array_sort(F.map_keys(full)), lambda k: F.concat(k, F.lit("="), F.element_at(full, k))), "; ")


def session_snapshot(messages: DataFrame) -> DataFrame:
    """conv_id, turns, messages, last_user, last_assistant."""
    at = F.struct("turn", "role")
    of = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, at))
    return messages.groupBy("conv_id").agg(F.max("turn").alias("turns"), F.count("*").alias("messages"), of("user").alias("last_user"), of("assistant").alias("last_assistant"))


#: What may happen to a session; put adds a message (key: its role), note sets a piece of metadata.
CONTROLS = ("create", "clear", "delete")


def _lives(events: DataFrame) -> DataFrame:
    """Control events (a few a session) with what holds after each until the next: alive, born (when the session was created), since (when
    its messages began), next; and alive_before."""
    order = Window.partitionBy("conv_id").orderBy("seq")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.col("op") != "clear", F.col("op") == "create")
    rows = events.where(F.col("op").isin(*CONTROLS)).select("conv_id", "seq", "op")
    rows = rows.withColumn("alive_before", F.coalesce(F.last(starts, True).over(before), F.lit(False)))
    rows = rows.withColumn("alive", F.coalesce(F.last(starts, True).over(so_far), F.lit(False)))
    created = (F.col("op") == "create") & ~F.col("alive_before")
    rows = rows.withColumn("born", F.last(F.when(created, F.col("seq")), True).over(so_far))
    cleared = created | ((F.col("op") == "clear") & F.col("alive_before"))
    rows = rows.withColumn("since", F.last(F.when(cleared, F.col("seq")), True).over(so_far))
    return rows.withColumn("next", F.lead("seq").over(order))


def replay(events: DataFrame) -> DataFrame:
    """conv_id, seq, op, status of session events (conv_id, seq, op, key, value), in the order of seq, which is unique in a session. A session
    that is created twice is DUPLICATE; anything on one that isn't there is NOT_FOUND. Only control events pass a window; messages meet
    the life that they fall in by a join, which Spark splits where a session has very many."""
    lives = _lives(events)
    done = F.col("op")
    control = F.when(done == "create", F.when(F.col("alive_before"), "DUPLICATE").otherwise("CREATED")).when(~F.col("alive_before"), "NOT_FOUND").when(done == "clear", "CLEARED").otherwise("DELETED")
    out = lives.select("conv_id", "seq", "op", control.alias("status"))
    spans = lives.select("conv_id", F.col("seq").alias("from_seq"), F.col("next").alias("to_seq"), "alive")
    rest = events.where(~F.col("op").isin(*CONTROLS)).select("conv_id", "seq", "op")
    inside = (rest["conv_id"] == spans["conv_id"]) & (rest["seq"] > spans["from_seq"]) & (spans["to_seq"].isNull() | (rest["seq"] < spans["to_seq"]))
    found = F.when(~F.coalesce("alive", F.lit(False)), "NOT_FOUND").when(F.col("op") == "get", "FOUND").otherwise("STORED")
    return out.unionByName(rest.join(spans, inside, "left").select(rest["conv_id"], "seq", "op", found.alias("status")))


def session_table(events: DataFrame) -> DataFrame:
    """conv_id, messages, last_user, metadata of the sessions that are there after all events: messages since the last clear; metadata,
    latest value of a key, since the creation, so a clear leaves them."""
    last = _lives(events).groupBy("conv_id").agg(*(F.max_by(c, "seq").alias(c) for c in ("alive", "born", "since"))).where("alive")
    said = events.join(last.select("conv_id", "born", "since"), "conv_id")
    at = F.col("seq")
    user = (F.col("op") == "put") & (F.col("key") == "user")
    messages = said.where(at > F.col("since")).groupBy("conv_id").agg(F.count_if(F.col("op") == "put").alias("messages"), F.max_by(F.when(user, F.col("value")), F.when(user, at)).alias("last_user"))
    notes = said.where((F.col("op") == "note") & (at > F.col("born"))).groupBy("conv_id", "key").agg(F.max_by("value", "seq").alias("value"))
    notes = notes.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))
    out = last.select("conv_id").join(messages, "conv_id", "left").join(notes, "conv_id", "left")
    return out.select("conv_id", F.coalesce("messages", F.lit(0).cast("long")).alias("messages"), "last_user", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
