"""Sheets as cell tables (sheet, row, col, value): headers found, filled and flattened with windows over one sheet each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A header row fills at least this share of the widest row, and this share of its cells are words.
FILLED, WORDS = 0.9, 0.6


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def is_word(c: Column) -> Column:
    return c.isNotNull() & c.try_cast("double").isNull()


def header_window(cells: DataFrame, rows: int = 25) -> DataFrame:
    """The first rows of each sheet."""
    return cells.where(F.col("row") < rows)


def detect_header_row(cells: DataFrame) -> DataFrame:
    """(sheet, header_row): the earliest full row of words, else the earliest full row, else 0."""
    v = blank_to_null(F.col("value"))
    rows = cells.groupBy("sheet", "row").agg(F.count(v).alias("filled"), F.count_if(is_word(v)).alias("words"))
    full = F.col("filled") >= FILLED * F.max("filled").over(Window.partitionBy("sheet"))
    rows = rows.withColumn("full", full & (F.col("filled") > 0)).withColumn("named", F.col("full") & (F.col("words") >= WORDS * F.col("filled")))
    return rows.groupBy("sheet").agg(F.coalesce(F.min(F.when(F.col("named"), F.col("row"))), F.min(F.when(F.col("full"), F.col("row"))), F.lit(0)).alias("header_row"))


def locate_header_row(cells: DataFrame, first: str = "sno") -> DataFrame:
    """(sheet, header_row) of the first row whose first cell says ``first`` when only letters and digits count."""
    same = F.regexp_replace(F.lower("value"), "[^a-z0-9]", "") == first
    return cells.where((F.col("col") == 0) & same).groupBy("sheet").agg(F.min("row").alias("header_row"))


def locate_data_row(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, header_row, data_row): the first row below whose first cell is a number."""
    first = cells.where((F.col("col") == 0) & F.col("value").rlike(r"^\s*\d+\s*$")).join(headers, "sheet")
    return first.where(F.col("row") > F.col("header_row")).groupBy("sheet", "header_row").agg(F.min("row").alias("data_row"))


def fill_segments(df: DataFrame, scope: list[str], order: str, value: str, reset: str) -> DataFrame:
    """``value`` carried forward, anew from each row where ``reset`` is true."""
    w = Window.partitionBy(*scope).orderBy(order)
    segment = F.sum(F.col(reset).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inside = Window.partitionBy(*scope, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_segment", segment).withColumn("filled", F.last(value, ignorenulls=True).over(inside)).drop("_segment")


def flatten_header(band: DataFrame) -> DataFrame:
    """(sheet, col, name) of a header band (sheet, level, col, value): labels carried over the columns they span, not past a column
    where a higher level has a label of its own, joined from top to bottom without blanks and neighbouring repeats."""
    own = band.select("sheet", "level", "col", blank_to_null(F.col("value")).alias("label"))
    above = Window.partitionBy("sheet", "col").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("reset", F.coalesce(F.count("label").over(above) > 0, F.lit(False)))
    filled = fill_segments(own, ["sheet", "level"], "col", "label", "reset")
    labels = filled.groupBy("sheet", "col").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("filled").isNotNull(), F.struct("level", "filled")))), lambda x: x["filled"]).alias("labels"))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    parts = F.aggregate("labels", F.array().cast("array<string>"), lambda a, x: F.when(last(a).eqNullSafe(x), a).otherwise(F.concat(a, F.array(x))))
    return labels.select("sheet", "col", F.when(F.size(parts) > 0, F.array_join(parts, " | ")).otherwise(F.concat(F.lit("column_"), F.col("col").cast("string"))).alias("name"))


def records(cells: DataFrame, names: DataFrame, starts: DataFrame) -> DataFrame:
    """(sheet, row, record): each row from ``starts`` (sheet, data_row) on as a map from column name, given ``names`` (sheet, col, name)."""
    data = cells.join(starts.select("sheet", "data_row"), "sheet").where(F.col("row") >= F.col("data_row"))
    named = data.join(names.select("sheet", "col", "name"), ["sheet", "col"])
    return named.groupBy("sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.col("value"))))).alias("record"))
