"""Sampling, splitting and ranks that don't depend on how data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import fixed

SEED = 42


def shuffle_key(column: str, seed: int = SEED) -> Column:
    """md5 of the id with a seed: an order that every engine reproduces."""
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f":{seed}")).cast("binary"))


def sample_rows(df: DataFrame, n: int, column: str, seed: int = SEED) -> DataFrame:
    return df.orderBy(shuffle_key(column, seed), column).limit(n)


def stratified(df: DataFrame, strata: list[str], target: int, column: str, seed: int = SEED) -> DataFrame:
    """About ``target`` rows: each stratum gives at most ceil(target / strata) of its rows, in shuffled order; rows with a null
    stratum are left out. A table of at most ``target`` rows is returned as it is."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_rows"))  # one pass over the strata's columns
    known = " AND ".join(f"`{s}` IS NOT NULL" for s in strata)
    facts = sizes.agg(F.sum("_rows").alias("_n"), F.count_if(F.expr(known)).alias("_g")).first()
    if (facts["_n"] or 0) <= target or not facts["_g"]:
        return df
    cap = -(-target // facts["_g"])
    # each task passes on no more than ``cap`` rows of a stratum; the digest is computed once
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy("_digest", column))
    ranked = df.where(known).withColumn("_digest", shuffle_key(column, seed)).withColumn("_rank", rank).where(F.col("_rank") <= cap)
    return ranked.orderBy("_digest", column).limit(target).drop("_rank", "_digest")


def split(df: DataFrame, column: str, share: float = 0.8, seed: int = SEED) -> DataFrame:
    """Adds ``part``: train for ids whose digest is in the first ``share`` of all digests, else test."""
    head = F.conv(F.substring(shuffle_key(column, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("part", F.when(head < int(share * 2**32), "train").otherwise("test"))


def recent(df: DataFrame, session: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each session; all of them if n is not positive."""
    if n <= 0:
        return df
    rank = F.row_number().over(Window.partitionBy(session).orderBy(*(F.col(c).desc() for c in order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def surrogate_key(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """Adds 1, 2, 3 ... in the order given (nulls first), without moving all rows to one task: rows are dealt by ranges of the order,
    counted inside their range and fixed in the shared folder; each adds what lies in the ranges before its own. Ties follow a hash of
    the row, so that a common key is dealt to several ranges; equal rows get adjoining ids."""
    hashed = [F.col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    ranged = df.withColumn("_tie", F.xxhash64(*hashed)).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    # the number of the range in the upper bits, of the row inside it in the lower 33: no window, so the rows move once
    inside = fixed(ranged.withColumn("_place", F.monotonically_increasing_id()))
    part, number = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = inside.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(before), part == F.col("_part")).withColumn(name, (number + F.col("_before") + 1).cast("long")).drop("_part", "_place", "_before", "_tie")
