"""Connected components of an edge table by alternating large-star and small-star rounds; each round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import temporary, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "small")
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node with an edge (a, b: long), except roots; the root is the component's smallest node."""
    with temporary(edges.sparkSession) as keep:
        edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        state = _state(edges)
        for _ in range(most_rounds):
            edges = written(_small_star(_large_star(edges)), "edges")
            before, state = state, _state(edges)
            if state == before:
                return keep(edges).select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
