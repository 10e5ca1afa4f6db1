"""Raw tables into clean ones: names, columns, types, unions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that only count rows.
ROW_COUNTERS = ("_id", "SlNo", "S.No")


def snake_case(c: Column) -> Column:
    """Identifier of a label: % becomes percent, parentheses open, everything else an underscore."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), "%", " percent "), r"[()]", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def make_unique(df: DataFrame, name: str, order: str, scope: list[str] | None = None) -> DataFrame:
    """The second of equal names gets _1, the third _2."""
    n = F.row_number().over(Window.partitionBy(*(scope or []), name).orderBy(order)) - 1
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 0, F.concat(F.col(name), F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")


def tidy_names(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Without row counters, renamed."""
    return df.drop(*(f"`{c}`" if "." in c else c for c in ROW_COUNTERS if c in df.columns)).withColumnsRenamed(renames)


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exactly ``columns`` (name to type) in their order; absent ones are null."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in columns.items()))


def reorder(df: DataFrame, first: list[str], last: list[str]) -> DataFrame:
    middle = [c for c in df.columns if c not in first and c not in last]
    return df.select(*(c for c in first if c in df.columns), *middle, *(c for c in last if c in df.columns))


def only_measure(df: DataFrame, known: set[str]) -> str | None:
    """The one column that isn't known; None if there are none or several."""
    left = [c for c in df.columns if c not in known and c not in ROW_COUNTERS]
    return left[0] if len(left) == 1 else None


def measurement_type(label: Column, subject: str) -> Column:
    """What a column's label says beyond its subject and its unit in parentheses; the label itself if nothing."""
    rest = F.regexp_replace(F.replace(F.regexp_replace(label, r"\(.*?\)", ""), F.lit(subject), F.lit("")), r"(?U)\s+", " ")
    return F.coalesce(F.nullif(F.trim(rest), F.lit("")), label)


def unpivot_measure(df: DataFrame, known: set[str], subject: str, value: str) -> DataFrame | None:
    """The frame with its one measurement column as ``value`` and a measurement_type; None if it hasn't exactly one."""
    column = only_measure(df, known)
    if column is None:
        return None
    return df.withColumnRenamed(column, value).withColumn("measurement_type", measurement_type(F.lit(column), subject))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_all(df: DataFrame) -> DataFrame:
    return df.select(*(strip(F.col(f"`{n}`")).alias(n) if k == "string" else F.col(f"`{n}`") for n, k in df.dtypes))


def clean_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def extract_year(c: Column) -> Column:
    """The first run of four digits; null without one."""
    return F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit(""))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def timeseries_master(files: dict[str, DataFrame], renames: dict[str, str], subject: str, value: str, columns: dict[str, str]) -> DataFrame | None:
    """One tall table of the files that have exactly one measurement column, without repeated rows; ``time`` gives the year."""
    parts = []
    for name, df in files.items():
        tall = unpivot_measure(df, set(renames), subject, value)
        if tall is None:
            continue
        tall = strip_all(tidy_names(tall, renames))
        year = extract_year(F.col("observation_time")) if "observation_time" in tall.columns else F.lit(None).cast("string")
        parts.append(conform(tall.withColumns({"year": year, "source_file": F.lit(name)}), columns).dropDuplicates())
    return union(parts) if parts else None


def safe_name(label: str) -> str:
    """snake_case for names known on the driver."""
    plain = re.sub(r"[()]", " ", label.lower().replace("%", " percent "))
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")
