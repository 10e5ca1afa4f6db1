"""Feature columns for regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats of time texts, day first.
TIME_FORMATS = ("dd-MM-yyyy HH:mm", "dd-MM-yyyy", "dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def parse_time(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in TIME_FORMATS))


def year_key(c: Column) -> Column:
    """Rounded half to even, as a nullable integer."""
    return F.bround(c.try_cast("double")).cast("long")


def impute_constant(df: DataFrame, columns: list[str], value: str = "unknown") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls become the column's exact median, found in one aggregate."""
    medians = df.agg(*(F.percentile(c, 0.5).alias(f"_{c}") for c in columns))
    return df.join(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")) for c in columns}).drop(*(f"_{c}" for c in columns))


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    facts = df.agg(*(F.avg(c).alias(f"_m{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s{c}") for c in columns))
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{c}"), F.nullif(F.col(f"_s{c}"), F.lit(0.0))), F.when(F.col(c).isNotNull(), 0.0)) for c in columns}
    return df.join(F.broadcast(facts)).withColumns(scaled).drop(*(f"_m{c}" for c in columns), *(f"_s{c}" for c in columns))


def regression_metrics(df: DataFrame, truth: str, guess: str, least: float = 1.0) -> DataFrame:
    """One row: mae, rmse, r2 and mape over truths of at least ``least`` (null without any)."""
    y, e = F.col(truth), F.col(truth) - F.col(guess)
    sst = F.var_pop(y) * F.count(y)
    return df.where(y.isNotNull() & F.col(guess).isNotNull()).agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), sst)).alias("r2"),
        F.avg(F.when(F.abs(y) >= least, F.abs(e) / F.abs(y))).alias("mape"),
    )
