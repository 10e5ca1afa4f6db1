"""Lines that an earlier document holds are dropped, with Spark's own functions only: levelled sorted runs of line hashes.

A line's key is the line without blanks at its ends, A-Z in lower case; keys of fewer than ``least`` code points are never dropped. What
has been seen so far lies in runs: tables of key hashes (the first 128 bits of SHA-256), dealt to buckets by hash and sorted in them.
``LineRuns.add`` takes a batch of documents: its keys, one row each, are anti-joined by merging with every run; what is left is the
batch's own run. A line is dropped if a run before its batch holds its key, or if a smaller doc_id of the batch does. ``fan`` runs of a
level are merged into one of the next, so a batch meets a number of runs that grows with the logarithm of the batches.

Each key is aggregated before it is shuffled, so a line that a third of the documents hold is one row a task. Lines then meet the keys
that drop some of them (and only those) in a join between two shuffles, which Spark splits where a key is frequent. A document's text
is shuffled once, at the end, to meet its dropped positions.

``drop_repeated_lines`` deals a table to ``batches`` batches by quantiles of doc_id, smaller ones first, so the smallest doc_id that holds
a key keeps its lines.

Defined cases: a null or empty text is one empty line, which stays; a doc_id that repeats counts as one document, whose rows all keep
what it keeps; a null doc_id is one document that comes last; a key that repeats inside its first document stays there as often as it
stands; an empty table gives an empty result; other columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, collected, drop_tables, table, temporary, written


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(ASCII_SPACE))
    plain = F.length(bare) == F.octet_length(bare)  # lower() leaves nothing but A-Z to change there
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, ascii_uppercase, ascii_lowercase))


def line_hashes(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, digest (of the text), pos, key of each line that may be dropped; positions count from 0."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = lines.select("doc_id", "digest", "pos", line_key(F.col("line")).alias("line")).where(F.length("line") >= least)
    return keys.select("doc_id", "digest", "pos", F.substring(F.unhex(F.sha2("line", 256)), 1, 16).alias("key"))


@contextmanager
def sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """Spark takes a bucket that is one file as sorted, as the runs are, and merges without sorting again."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Runs of the keys seen so far, by level, as (table, rows); ``add`` gives a batch's dropped lines and adds the batch's run. Within a
    ``with`` block the runs go at its end; else they stay for later batches until ``drop``."""

    def __init__(self, spark: SparkSession, fan: int = 4):
        self.spark, self.fan = spark, fan
        self.levels: list[list[tuple[str, DataFrame]]] = []

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def drop(self) -> None:
        for level in self.levels:
            drop_tables(self.spark, level)

    def add(self, lines: DataFrame) -> DataFrame:
        """doc_id, digest, pos of the lines to drop, out of ``line_hashes`` of a batch. Documents of later batches count as later ones."""
        with sorted_buckets(self.spark), temporary(self.spark) as keep:
            one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")  # null after every id
            held = lines.groupBy("key").agg(F.min(one).alias("first"), F.max(one).alias("last"))
            held = written(held, "batch_keys", "key", ordered=True)
            runs = [run for level in self.levels for _, run in level]
            fresh = reduce(lambda df, run: df.join(run.hint("merge"), "key", "left_anti"), runs, held.select("key"))
            run = self._run(fresh)
            # keys whose lines go: in every document if a run held the key before, else in all but the first
            known = held.join(run[1].withColumn("fresh", F.lit(True)).hint("merge"), "key", "left")
            going = known.where(F.col("fresh").isNull() | (F.col("first") != F.col("last"))).select("key", F.when(F.col("fresh"), F.col("first")).alias("owner"))
            going = written(going, "going")
            theirs = F.col("owner").isNull() | (F.col("owner") != one)
            dropped = keep(written(lines.join(going, "key").where(theirs).select("doc_id", "digest", "pos"), "dropped"))
            self._push(run, 0)
        return dropped

    def _run(self, keys: DataFrame) -> tuple[str, DataFrame]:
        own: list[tuple[str, DataFrame]] = []
        with collected(own):
            written(keys, "run", "key", ordered=True)
        return own[0]

    def _push(self, run: tuple[str, DataFrame], level: int) -> None:
        """Adds a run to a level; ``fan`` runs of a level become one of the next."""
        if level == len(self.levels):
            self.levels.append([])
        full = self.levels[level]
        full.append(run)
        if len(full) == self.fan:
            merged = self._run(reduce(DataFrame.union, (rows for _, rows in full)))
            drop_tables(self.spark, full)
            self._push(merged, level + 1)


def dropped_lines(docs: DataFrame, batches: int = 4, fan: int = 2, least: int = 10) -> DataFrame:
    """doc_id, digest, gone (positions of the dropped lines) of each document that loses some."""
    spark = docs.sparkSession
    with temporary(spark) as keep, LineRuns(spark, fan) as runs:
        shares = [k / batches for k in range(1, batches)]
        bounds = docs.agg(F.percentile_approx("doc_id", shares, 10_000).alias("bounds")).first()["bounds"] or []
        batch = reduce(lambda c, k: F.when(F.col("doc_id") <= bounds[k], k).otherwise(c), reversed(range(len(bounds))), F.lit(len(bounds)))
        lines = written(line_hashes(docs, least).withColumn("batch", batch), "lines", folders="batch")
        parts = [runs.add(lines.where(F.col("batch") == k).drop("batch")) for k in range(len(bounds) + 1)]
        gone = reduce(DataFrame.union, parts).groupBy("doc_id", "digest").agg(F.collect_set("pos").alias("gone"))
        return keep(written(gone, "gone"))


def drop_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """row (the row of ``docs`` as a struct), n_lines, n_dropped and kept, the text without its dropped lines."""
    gone = dropped_lines(docs, **settings)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    whole = docs.select(F.struct("*").alias("row"), lines.alias("lines"), F.xxhash64("text").alias("digest"))
    same = whole["row.doc_id"].eqNullSafe(gone["doc_id"]) & (whole["digest"] == gone["digest"])
    every = whole.join(gone, same, "left").select("row", "lines", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # by a hash set, in order
    kept = F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.transform(left, lambda at: F.get("lines", at)))
    return every.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("kept"))


def without_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, dropped lines cut from ``text``; a text that loses none stays as it is, null included."""
    found = drop_repeated_lines(docs, **settings)
    text = F.when(F.col("n_dropped") > 0, F.col("kept")).otherwise(F.col("row.text"))
    return found.select(*((text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op12_line_dedup": r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
owned AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.r, k.pos, k.line, coalesce(o.owner <> k.doc_id, false) AS gone FROM keyed k LEFT JOIN owned o USING (key))
SELECT d.doc_id, j.n_lines, j.n_dropped, sha256(coalesce(j.kept, '')) AS kept_sha256
FROM docs d JOIN (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS kept FROM judged GROUP BY r) j USING (r)
"""
}
