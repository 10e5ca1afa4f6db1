"""Joins that never multiply rows: lookups, validated enrichment, outer merges of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of matched rows, in percent, from which an enrichment is included.
LEAST_MATCH = 1.0


def key_of(column: str | Column, nan_key: bool = False) -> Column:
    """Upper case without blanks around. A missing key stays null and never matches, unless ``nan_key`` asks for the text NAN."""
    key = F.upper(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.coalesce(key, F.lit("NAN")) if nan_key else key


def enrich(base: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Left join with a ``matched`` flag. ``facts`` has one row a key (aggregate first), so rows never multiply; Spark picks the join by size."""
    return base.join(facts.withColumn("_there", F.lit(True)), keys, "left").withColumn("matched", F.coalesce("_there", F.lit(False))).drop("_there")


def match_report(enriched: DataFrame, least: float = LEAST_MATCH) -> DataFrame:
    n, hit = F.count("*"), F.count_if(F.col("matched"))
    percent = F.round(100.0 * hit / F.nullif(n, F.lit(0)), 4)
    return enriched.agg(n.alias("n_rows"), hit.alias("matched_rows"), (n - hit).alias("unmatched_rows"), percent.alias("match_percent")).withColumn("included", F.coalesce(F.col("match_percent") >= least, F.lit(False)))


def merge_references(parts: list[DataFrame], key: str) -> DataFrame:
    """Full outer merge of tables with one row a key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full")
    return out


def first_wins(df: DataFrame, key: Column, value: str, order: str) -> DataFrame:
    """(key, value): of each key the value of its first row by ``order``."""
    return df.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.min_by(value, order).alias(value))


def not_yet(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_anti")


def already(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_semi")
