"""Vectors: embedding, exact cosine search, provenance of hits."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l2(v: Column, of_zero: float | None = None) -> Column:
    """To length one; null components stay and don't count. A zero vector stays, or has ``of_zero`` as each component."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))
    rest = (lambda x: x.cast("double")) if of_zero is None else (lambda x: F.when(x.isNotNull(), F.lit(of_zero)))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, rest))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as a product with 10^digits, halves away from zero; unlike ``round`` it keeps the sign of a zero."""
    scaled = x * F.lit(10.0**digits)
    whole = F.rint(scaled)
    return F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole) / F.lit(10.0**digits)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hashed_words(texts: list[str], dim: int = 64) -> np.ndarray:
    """The offline embedder: hashed bag of words, normalised."""
    out = np.zeros((len(texts), dim))
    for row, t in zip(out, texts, strict=True):
        for w in (t or "").lower().split():
            row[zlib.crc32(w.encode()) % dim] += 1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def embed(df: DataFrame, column: str, model: Callable[[], Callable[[list[str]], np.ndarray]] | None = None, batch: int = 64) -> DataFrame:
    """Adds ``embedding``. ``model`` makes an embedder, once in each worker."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model() if model else hashed_words
        for part in parts:
            rows = [r for i in range(0, len(part), batch) for r in own(part.iloc[i : i + batch].tolist())]
            yield pd.Series(rows, index=part.index)

    return df.withColumn("embedding", run(F.col(column)))


def embed_query(question: str, model: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> list[float]:
    """One question's vector, made as those of the chunks are; a blank question is an error."""
    if not question or not question.strip():
        raise ValueError("the question is empty")
    own = model() if model else hashed_words
    return [float(x) for x in own([question.strip()])[0]]


def embed_queries(df: DataFrame, column: str, model: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> DataFrame:
    """Adds ``embedding`` and ``error``: each row's question as a vector, made as those of the chunks are; a blank one is an error."""
    bare = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?U)^\s+|\s+$", "")
    taken = "_question"
    while taken in df.columns:
        taken += "_"
    asked = embed(df.withColumn(taken, bare), taken, model)
    blank = F.col(taken) == ""
    return asked.withColumn("error", F.when(blank, "the question is empty")).withColumn("embedding", F.when(~blank, F.col("embedding"))).drop(taken)


def usable(v: Column) -> Column:
    """Has a direction: no null or non-finite component, not zero. Other vectors take no part in a search, as rows and as queries."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & whole & F.exists(v, lambda x: x != 0), F.lit(False))


def top_k(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id") -> DataFrame:
    """key, score: the ``k`` rows most like one query; ties by key. No shuffle of vectors. Rows of another dimension, and those that aren't
    ``usable``, take no part; where usable rows have other dimensions only, the query is an error. A zero query has no hits."""
    none = vectors.select(key, F.lit(0.0).alias("score")).where("false")
    if k <= 0:
        return none
    vectors = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")))
    sizes = vectors.agg(F.max((F.size("embedding") == len(query)).cast("int")).alias("fits"), F.max(F.size("embedding")).alias("n")).first()
    if sizes["fits"] == 0:
        raise ValueError(f"the query has {len(query)} dimensions, the vectors have {sizes['n']}")
    if not np.isfinite(query).all() or not np.any(query):
        return none
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.where(F.size("embedding") == len(query)).select(key, cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _block(column: pa.ListArray, row: int, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of a block, which is a list of (key, embedding) of one dimension."""
    rows = column[row].values
    x = rows.field("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return rows.field(key).to_numpy(zero_copy_only=False), x / np.linalg.norm(x, axis=1, keepdims=True)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by id; only what reaches the k-th score is sorted."""
    places = np.arange(len(scores))
    if k < len(scores):
        places = places[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def blocked(df: DataFrame, key: str, count: int, name: str) -> DataFrame:
    """dim, ``name``, ``name``_rows: the usable rows in ``count`` blocks for each dimension. Rows are dealt by key, vector and the partition
    they come from, so that neither an id that many rows share nor copies of one row fill a block."""
    rows = df.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding")) & F.col(key).isNotNull())
    place = F.pmod(F.xxhash64(key, "embedding", F.spark_partition_id()), F.lit(count))
    return rows.select(F.size("embedding").alias("dim"), place.alias(name), F.struct(key, "embedding").alias("row")).groupBy("dim", name).agg(F.collect_list("row").alias(f"{name}_rows"))


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048, query_block: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for each of ``queries`` (query_id, embedding): blocks of queries meet blocks of vectors of their
    dimension. Rows and queries that aren't ``usable`` take no part."""
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank long")
    n = vectors.count()
    blocks = max(1, -(-n // block))
    parts = max(1, -(-queries.count() // query_block))

    held, asked = blocked(vectors, "vec_id", blocks, "block"), blocked(queries, "query_id", parts, "part")
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(held, ["dim", "block"]).select("part_rows", "block_rows")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                asked_ids, q = _block(b.column(0), row, "query_id")
                ids, x = _block(b.column(1), row, "vec_id")
                s = np.clip(q @ x.T, -1, 1)
                best = [best_of(s[j], ids, k) for j in range(len(asked_ids))]
                found = np.concatenate(best)
                at = np.repeat(np.arange(len(asked_ids)), [len(x) for x in best])
                yield pa.RecordBatch.from_arrays([pa.array(asked_ids[at]), pa.array(ids[found]), pa.array(s[at, found])], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(score, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def assign_ids(existing: DataFrame, fresh: DataFrame, order: str) -> DataFrame:
    """Rows of ``fresh`` with embedding_id going on after the largest one there."""
    from ..operators.sampling import surrogate_key

    last = existing.agg(F.coalesce(F.max("embedding_id"), F.lit(-1)).alias("_last"))
    return surrogate_key(fresh, [order], "_n").join(F.broadcast(last)).withColumn("embedding_id", F.col("_n") + F.col("_last")).drop("_n", "_last")


def resolve(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk's provenance; ids without a chunk are left out."""
    return hits.join(chunks, "embedding_id")


def envelope(resolved: DataFrame, question: str) -> DataFrame:
    """One row: question, status and the evidence by rank."""
    rows = resolved.agg(F.array_sort(F.collect_list(F.struct("rank", "embedding_id"))).alias("evidence"))
    return rows.select(F.lit(question).alias("question"), F.when(F.size("evidence") > 0, "SUCCESS").otherwise("NO_RESULTS").alias("status"), F.size("evidence").cast("long").alias("n_evidence"))


def alignment(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: do vectors and chunks have the same ids, once each?"""
    a, b = vectors.select("embedding_id", F.lit(1).alias("v"), F.lit(0).alias("c")), chunks.select("embedding_id", F.lit(0).alias("v"), F.lit(1).alias("c"))
    both = a.unionByName(b).groupBy("embedding_id").agg(F.sum("v").alias("v"), F.sum("c").alias("c"))
    return both.agg(F.sum("v").alias("vectors"), F.sum("c").alias("chunks"), F.coalesce(F.bool_and((F.col("v") == 1) & (F.col("c") == 1)), F.lit(True)).alias("aligned"))
