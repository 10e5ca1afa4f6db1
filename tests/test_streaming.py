"""Streams over files."""

from pyspark.sql import functions as F

from millrace.streaming import ingest


def test_each_content_is_taken_once(spark, tmp_path):
    source, manifest = str(tmp_path / "in"), str(tmp_path / "manifest")
    for texts in (["a", "b", "a", None], ["b", "c"]):
        spark.createDataFrame([(t,) for t in texts], "text string").write.mode("append").parquet(source)
        ingest.ingest(ingest.stream_documents(spark, source, "text string"), manifest, str(tmp_path / "point")).awaitTermination()
    assert sorted(r["text"] for r in spark.read.parquet(manifest).collect()) == ["a", "b", "c"]


def test_a_batch_reads_no_manifest(spark, tmp_path):
    """Known contents are in the state: they stay out even where the manifest is gone, and a batch replaces its own part when run again."""
    source, manifest, seen = str(tmp_path / "in"), tmp_path / "manifest", []
    for number, texts in enumerate((["a", "b"], ["b", "c"], ["a", "d"])):
        spark.createDataFrame([(t,) for t in texts], "text string").write.mode("append").parquet(source)
        stream = ingest.stream_documents(spark, source, "text string")
        ingest.ingest(stream, str(manifest), str(tmp_path / "point"), process=lambda df: seen.extend(r["text"] for r in df.collect())).awaitTermination()
        if number == 0:
            manifest.rename(tmp_path / "elsewhere")
    assert sorted(seen) == ["a", "b", "c", "d"] and sorted(r["text"] for r in spark.read.parquet(str(manifest)).collect()) == ["c", "d"]
    commits = tmp_path / "point" / "commits"
    last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (last, commits / f".{last.name}.crc"):
        p.unlink(missing_ok=True)  # as after a crash between the batch and its commit
    ingest.ingest(ingest.stream_documents(spark, source, "text string"), str(manifest), str(tmp_path / "point"), process=lambda df: seen.extend(r["text"] for r in df.collect())).awaitTermination()
    assert seen[4:] in ([], ["d"]) and sorted(r["text"] for r in spark.read.parquet(str(manifest)).collect()) == ["c", "d"]


def test_contents_are_forgotten(spark, tmp_path):
    source, manifest = str(tmp_path / "in"), str(tmp_path / "manifest")
    taken = []
    for day, text in ((1, "a"), (2, "a"), (20, "b"), (21, "a"), (21, "b")):
        spark.createDataFrame([(text, f"2024-01-{day:02d} 00:00:00")], "text string, ts string").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(source)
        stream = ingest.stream_documents(spark, source, "text string, ts timestamp")
        ingest.ingest(stream, manifest, str(tmp_path / "point"), process=lambda df, day=day: taken.extend((day, r["text"]) for r in df.collect()), time="ts", keep="5 days").awaitTermination()
    assert taken == [(1, "a"), (20, "b"), (21, "a")]


def test_running_turns(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "user"), (1, "assistant"), (1, "user"), (2, "user")], "conv_id long, role string").write.parquet(source)
    stream = ingest.running_turns(spark.readStream.schema("conv_id long, role string").parquet(source))
    stream.writeStream.format("memory").queryName("turns").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert {(r["conv_id"], r["turns"]) for r in spark.table("turns").collect()} == {(1, 2), (2, 1)}


def test_idle_sessions_are_forgotten(spark, tmp_path):
    source, point = str(tmp_path / "in"), str(tmp_path / "point")
    turns = {}
    for day, conv in ((1, 1), (20, 2), (21, 2), (22, 1)):
        spark.createDataFrame([(conv, "user", f"2024-01-{day:02d} 00:00:00")], "conv_id long, role string, ts string").withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(source)
        stream = ingest.running_turns(spark.readStream.schema("conv_id long, role string, ts timestamp").parquet(source), "ts", 24)
        found = []
        stream.writeStream.foreachBatch(lambda df, _, found=found: found.extend(df.collect())).option("checkpointLocation", point).outputMode("update").trigger(availableNow=True).start().awaitTermination()
        turns[day] = {r["conv_id"]: r["turns"] for r in found}
    assert turns == {1: {1: 1}, 20: {2: 1}, 21: {2: 2}, 22: {1: 1}}


def test_windows(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(source)
    stream = ingest.windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(source))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r["n"], r["mean_value"]) for r in spark.table("windows").collect()] == [(2, 2.0)]
