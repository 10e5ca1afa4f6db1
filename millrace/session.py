"""Session settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # paths in statements would read files that no view names
    "spark.sql.runSQLOnFiles": "false",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "millrace", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; on a cluster the submitting side names master, memory and spark.checkpoint.dir."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A session on one machine without it gets one of its own; a cluster has to name it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` written once to the shared folder, so that each later use sees the same ones."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def spooled(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written once as Parquet to the shared folder, so that later reads of single columns don't run it again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
