"""What the operators share: reading tables, cutting lineage in the shared folder, Arrow mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that Python's ``bytes.split()`` and the word pattern ``[^\x20\x09-\x0D]+`` treat as separators.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Database of the tables between steps; it lies in the shared folder.
SCRATCH = "millrace_scratch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local one of our own, if all runs on this machine (tests);
    a cluster has to name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Tables that ``written`` makes inside the innermost block that lists them.
_LISTED: ContextVar[list[tuple[str, DataFrame]] | None] = ContextVar("listed", default=None)


def written(df: DataFrame, name: str, bucket: str | None = None, ordered: bool = False, folders: str | None = None) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation.

    ``bucket`` names a column by which rows are dealt to as many buckets as there are shuffle partitions, so that joins by it don't move them;
    ``ordered`` sorts each bucket by it too. ``folders`` names a column of few values whose rows lie in folders of their own.
    """
    spark = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {SCRATCH} LOCATION '{scratch_root(spark)}/{SCRATCH}'")
    full = f"{SCRATCH}.{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet")
    if bucket:
        writer = writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), bucket)
        writer = writer.sortBy(bucket) if ordered else writer
    if folders:
        writer = writer.partitionBy(folders)
    writer.saveAsTable(full)
    found = spark.table(full)
    if (listed := _LISTED.get()) is not None:
        listed.append((full, found))
    return found


def drop_tables(spark: SparkSession, tables: list[tuple[str, DataFrame]]) -> None:
    """Drops tables of ``written`` with their files."""
    while tables:
        spark.sql(f"DROP TABLE IF EXISTS {tables.pop()[0]}")


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside the block are dropped at its end, but for those handed to the function that it gives; these pass to the
    block around it. What a block returns may read only such tables."""
    own: list[tuple[str, DataFrame]] = []
    kept: list[tuple[str, DataFrame]] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.extend(x for x in own if x[1] is df)
        return df

    try:
        with collected(own):
            yield keep
    finally:
        if (around := _LISTED.get()) is not None:
            around.extend(kept)
        names = {name for name, _ in kept}
        drop_tables(spark, [x for x in own if x[0] not in names])


@contextmanager
def collected(into: list[tuple[str, DataFrame]]) -> Iterator[None]:
    """Tables written inside the block and not dropped there are listed in ``into``, for ``drop_tables`` later."""
    token = _LISTED.set(into)
    try:
        yield
    finally:
        _LISTED.reset(token)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for a function of one batch, called on slices of bounded bytes so that long texts can't pile up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes each; one row at least."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * most / max(most, batch.nbytes)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def fold(column: str, modulus: int) -> F.Column:
    """crc32 of an id's decimal text, by modulus; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, keep: F.Column | None = None, most_bytes: int | None = None) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labelled documents, chosen by the hash of their id; the labels' side is bounded and so broadcast.
    With ``most_bytes``, as many of them in that order as have no more text; one that alone has more is passed over, so that it can't empty
    the sample. Only ids and lengths meet in one task for that.

    Labels that repeat an id count as one (the larger), so do documents (the smallest digest); null labels and ids are left out.
    """
    y = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    if keep is not None:
        y = y.where(keep)
    y = y.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if most_bytes is not None:
        sizes = texts.join(F.broadcast(y), "doc_id").select("doc_id", "y", F.xxhash64("text").alias("digest"), F.octet_length("text").alias("size"))
        sizes = sizes.groupBy("doc_id").agg(F.min_by("size", "digest").alias("size"), F.first("y").alias("y")).where(F.col("size") <= most_bytes)
        so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        y = sizes.withColumn("so_far", F.sum("size").over(so_far)).where(F.col("so_far") <= most_bytes).select("doc_id", "y")
    found = texts.join(F.broadcast(y), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the first of the constant) by Newton's rounds."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        grad = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
