"""Filters, rankings and result guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A result is warned about beyond the first bound and refused beyond the second; it is never cut short.
WARN_ROWS, MOST_ROWS = 50, 200


def same_nocase(column: str, value: str) -> Column:
    return F.lower(F.trim(F.col(column))) == value.strip().lower()


def in_nocase(column: str, values: list[str]) -> Column:
    return F.lower(F.trim(F.col(column))).isin([v.strip().lower() for v in values])


def contains_nocase(column: str, part: str) -> Column:
    return F.col(column).ilike(f"%{part}%")


def finite(column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def latest(df: DataFrame, *order: str, n: int = 1) -> DataFrame:
    """The last rows by the order columns; the last of them has to break ties."""
    return df.orderBy(*(F.col(c).desc_nulls_last() for c in order)).limit(n)


def top(df: DataFrame, column: str, tie: str, n: int, largest: bool = True) -> DataFrame:
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if largest else c.asc_nulls_last(), tie).limit(n)


def at_maximum(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` equals its maximum; the maximum is one row."""
    newest = df.agg(F.max(column).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(column) == F.col("_newest")).drop("_newest")


def evidence(df: DataFrame) -> DataFrame:
    """Each row as JSON with names, values and nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("evidence"))


class TooManyRows(ValueError):
    pass


def capped(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """The rows for an answer. One row more than allowed is asked for, so that a larger result is refused and not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooManyRows(f"the result has more than {most} rows")
    return [r.asDict() for r in rows]


def cap_report(df: DataFrame, warn: int = WARN_ROWS, most: int = MOST_ROWS) -> DataFrame:
    """One row: how many rows were seen (``most`` + 1 at most), and the verdict."""
    seen = df.limit(most + 1).agg(F.count("*").alias("seen_rows"))
    return seen.withColumn("verdict", F.when(F.col("seen_rows") > most, "REJECT").when(F.col("seen_rows") > warn, "WARN").otherwise("OK"))
