"""Writing tables, and reading them back or finding nothing there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.inspect import declare_key
from ..operators.sampling import surrogate_key


def _writer(df: DataFrame, kind: str):
    return df.write.format(kind).options(**({"header": "true"} if kind == "csv" else {}))


def replace(df: DataFrame, path: str, by: list[str] | None = None, kind: str = "parquet") -> None:
    """One overwrite, as parquet, csv (with a header) or json; ``by`` lays rows out by those columns, so that filters on them skip files."""
    _writer(df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df, kind).mode("overwrite").save(path)


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    _writer(df, kind).mode("append").save(path)


def append_each(parts: list[DataFrame], path: str, kind: str = "parquet") -> None:
    """Starts afresh, then adds one part after the other."""
    for i, part in enumerate(parts):
        (append if i else replace)(part, path, kind=kind)


def load_or_empty(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet") -> DataFrame:
    """What was written, or no rows where nothing was."""
    try:
        reader = spark.read.options(**({"header": "true"} if kind == "csv" else {})).format(kind)
        return reader.load(path) if kind == "parquet" and isinstance(schema, str) else reader.schema(schema).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def save_table(df: DataFrame, name: str, order: list[str], path: str | None = None, bucket: str | None = None, buckets: int = 8, sort: list[str] | None = None) -> None:
    """Drops and recreates a table with a running ``id`` over ``order``, which is declared as its key. With ``bucket``, rows lie in ``buckets``
    parts by that column, sorted by ``sort``: joins and groups by it don't move them, as lookups by an index would. ``path`` makes it external."""
    writer = surrogate_key(df, order).write.mode("overwrite")
    writer = writer.option("path", path) if path else writer
    if bucket:
        writer = writer.bucketBy(buckets, bucket)
        writer = writer.sortBy(*sort) if sort else writer
    writer.saveAsTable(name)
    declare_key(df.sparkSession, name, ["id"])
