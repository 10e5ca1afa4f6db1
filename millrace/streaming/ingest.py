"""Documents that arrive over time: each content is taken in once, sessions keep their counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_documents(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def ingest(documents: DataFrame, manifest: str, checkpoint: str, process: Callable[[DataFrame], None] | None = None, time: str | None = None, keep: str = "30 days") -> StreamingQuery:
    """Takes in each content once: documents (text) of unknown content go to the manifest (doc_id, text; batch). What is known lies in the
    stream's keyed state, on each executor's disk and in ``checkpoint``, so a batch costs its own rows, however long the manifest. With
    an event ``time``, a content is forgotten ``keep`` after it was first seen; without one, never. A batch that is run again has
    the same rows and replaces its own part of the manifest; ``process`` sees it again."""
    known = documents.where("text is not null").withColumn("doc_id", F.sha2("text", 256))
    fresh = known.withWatermark(time, keep).dropDuplicatesWithinWatermark(["doc_id"]) if time else known.dropDuplicates(["doc_id"])

    def take(batch: DataFrame, number: int) -> None:
        new = batch.select("doc_id", "text")
        if process:
            process(new)
        new.write.mode("overwrite").parquet(f"{manifest}/batch={number}")

    conf = documents.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKS)  # keys on disk, not in the executors' heap
    try:
        return fresh.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(STATE_STORE, before) if before else conf.unset(STATE_STORE)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means by event_type and window; events later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))


def running_turns(messages: DataFrame, time: str | None = None, idle_hours: int = 24 * 30) -> DataFrame:
    """conv_id, turns: how many user messages each session has had so far. With a ``time`` column, a session without messages for
    ``idle_hours`` of event time is forgotten; without one, sessions are kept for ever."""

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        for f in frames:
            n += int((f["role"] == "user").sum())
            if time:
                last = max(last, int(f[time].max().timestamp() * 1000))
        state.update((n, last))
        if time:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_hours * 3_600_000)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n]})

    if time:
        messages = messages.withWatermark(time, f"{idle_hours} hours")
    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    return messages.groupBy("conv_id").applyInPandasWithState(count, "conv_id long, turns long", "turns long, last long", "update", timeout)
