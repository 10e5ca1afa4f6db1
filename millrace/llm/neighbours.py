"""Approximate nearest neighbours with an inverted multi-index.

The vectors' two halves are quantised by codebooks of their own, fitted on a bounded sample
(``sample_rows``, by hash of the vector). A cell is a pair of centroids. A query walks through the
pairs by rising sum of its two distances with a heap, until the cells that it met hold a share of
the different vectors; all rows of those cells are reranked by their exact distance. The share is
calibrated: probes from the sample are searched in the sample by brute force, and the walk is made
as long as ``recall`` of their neighbours needs. With n different vectors there are about n^0.5 / 2 centroids a half (256 at most): the finer
the cells, the shorter the walk. It is short for clustered vectors; vectors without structure still
need a good part of the index.

Every row is indexed. Equal vectors are one entry with the smallest ids that a result can name, so
a vector that a third of all rows share costs no more than another. Entries are stored in blocks of
``block_rows`` by their first centroid. A query travels to the blocks that its walk met with the
summed distance at which the walk ended, and takes there the cells within it; queries travel in
blocks likewise.

Vectors are compared within their dimension, each with an index of its own; walks meet ``k`` + 1
different vectors at least. On request (``exact_rows``, 0 unless given) dimensions of up to so many
different vectors are searched whole. Codebooks and cell counts (65,536 at most) of each dimension
are all that is broadcast.

Defined cases: vectors that are null, zero or hold null or non-finite parts take no part, nor do
rows without an id; an id found twice counts once as a candidate, by its nearest vector, and
queries by its smallest vector; a query is never its own neighbour; fewer candidates than ``k`` are
all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, table, temporary, written


def usable(v: Column) -> Column:
    """True for vectors that take part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct random rows; an empty cluster takes the row farthest from its own."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        d = _squared(x, centres)
        own = d.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        far = np.argsort(-d[np.arange(len(x)), own])
        for i, c in enumerate(np.flatnonzero(n == 0)):
            sums[c], n[c] = x[far[i]], 1
        centres = sums / n[:, None]
    return centres


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0)


class MultiIndex:
    """The two codebooks, and how many vectors each cell holds. Bounded: it travels in closures."""

    def __init__(self, sample: np.ndarray, k: int):
        self.dim = sample.shape[1]
        self.cut = self.dim // 2
        self.books = (kmeans(sample[:, : self.cut], k), kmeans(sample[:, self.cut :], k)) if self.cut else (np.zeros((1, 0)), kmeans(sample, k))
        self.counts: dict[int, int] = {}
        self.groups = 1

    def cells(self, x: np.ndarray) -> np.ndarray:
        first, second = (d.argmin(axis=1) for d in self.distances(x))
        return first * len(self.books[1]) + second

    def group(self, cells: np.ndarray) -> np.ndarray:
        """The group of each cell: some first centroids, as many as fill a block."""
        return self.dim * _GROUPS + cells // len(self.books[1]) * self.groups // len(self.books[0])

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of each vector's halves to their centroids."""
        return _squared(x[:, : self.cut], self.books[0]), _squared(x[:, self.cut :], self.books[1])

    def walk(self, q: np.ndarray, most: int) -> tuple[list[int], float]:
        """Filled cells by rising summed distance until they hold ``most`` vectors, and the sum at which the walk ended."""
        a, b = (d[0] for d in self.distances(q[None, :]))
        ai, bi = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        width, a, b, ai, bi = len(b), a[ai].tolist(), b[bi].tolist(), ai.tolist(), bi.tolist()
        heap, out, held, reach, counts = [(a[0] + b[0], 0, 0)], [], 0, 0.0, self.counts
        while heap and held < most:
            reach, i, j = heap[0]
            cell = ai[i] * width + bi[j]
            if n := counts.get(cell, 0):
                out.append(cell)
                held += n
            if j + 1 < width:
                heapq.heapreplace(heap, (a[i] + b[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out, reach

    def share(self, sample: np.ndarray, recall: float, k: int = 10, probes: int = 200) -> float:
        """Share of the vectors that a walk has to meet for ``recall`` of the neighbours of probes, measured in the sample."""
        needed = []
        all_a, all_b = self.distances(sample)
        first, second = all_a.argmin(axis=1), all_b.argmin(axis=1)
        for p in range(min(probes, len(sample))):
            q = sample[p]
            far = all_a[p][first] + all_b[p][second]
            d = ((sample - q) ** 2).sum(axis=1)
            d[p] = np.inf
            best = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            needed += (np.searchsorted(np.sort(far), far[best], side="right") / len(sample)).tolist()
        return float(np.quantile(needed, recall)) if needed else 1.0


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """(v, ids): each different vector with its ``ids`` smallest row ids; combined before the shuffle."""

    def combine(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[tuple, list[int]] = defaultdict(list)
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[tuple(v)].append(i)
        return pa.RecordBatch.from_arrays([pa.array([list(v) for v in seen], pa.list_(pa.float64())), pa.array([sorted(set(x))[:ids] for x in seen.values()], pa.list_(pa.int64()))], names=["v", "ids"])

    some = map_batches(rows, combine, "v array<double>, ids array<long>")
    return some.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, ids).alias("ids"))


def fit(rows: DataFrame, n: int, sample_rows: int, recall: float) -> tuple[MultiIndex, float]:
    """Codebooks from at most ``sample_rows`` vectors (v, of one dimension), and the share that walks have to meet."""
    sample = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(sample_rows).toArrow()
    x = _matrix(sample["v"].combine_chunks())
    index = MultiIndex(x, int(np.clip(round(n**0.5 / 2), 2, min(256, max(2, len(x) // 16)))))
    return index, index.share(x, recall)


#: Groups of a dimension, and the one of a dimension without an index.
_GROUPS, _WHOLE = 1 << 16, 1 << 15


def _placed(entries: DataFrame, index: MultiIndex) -> DataFrame:
    """Entries of the index' dimension with their cell and group."""

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = index.cells(_matrix(batch.column(0)))
        return pa.RecordBatch.from_arrays([pa.array(index.group(cells), pa.int64()), pa.array(cells, pa.int64()), *batch.columns], names=["grp", "cell", "v", "ids"])

    return map_batches(entries.where(F.size("v") == index.dim), place, "grp long, cell long, v array<double>, ids array<long>")


def _routed(asked: DataFrame, index: MultiIndex, most: int) -> DataFrame:
    """A row for each query of the index' dimension and each group that it visits, with the reach of its walk."""

    def route(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, groups, reaches = [], [], []
        for i, q in enumerate(_matrix(batch.column(1))):
            cells, reach = index.walk(q, most)
            for g in np.unique(index.group(np.array(cells))).tolist():
                at.append(i), groups.append(g), reaches.append(reach)
        chosen = batch.take(pa.array(at, pa.int32()))
        return pa.RecordBatch.from_arrays([*chosen.columns, pa.array(groups, pa.int64()), pa.array(reaches, pa.float64())], names=["query_id", "q", "grp", "reach"])

    return map_batches(asked.where(F.size("q") == index.dim), route, "query_id long, q array<double>, grp long, reach double")


def _best(q: np.ndarray, own: int, x: np.ndarray, ids: pa.ListArray, k: int) -> list[tuple[float, int]]:
    """(score, id) of the ``k`` nearest different ids among entries."""
    off = x - q
    d = np.sqrt((off * off).sum(axis=1))
    entries, found = k + 1, {}
    while True:  # until k different ids are found or no entry is left
        near = np.arange(len(d))
        if len(d) > entries:
            near = np.flatnonzero(d <= np.partition(d, entries - 1)[entries - 1])  # ties stay
        for i in near[np.argsort(d[near], kind="stable")].tolist():
            for v in ids[i].as_py():
                if v != own:
                    found.setdefault(v, float(d[i]))
        if len(found) >= k or len(near) == len(d):
            return sorted((s, v) for v, s in found.items())[:k]
        entries *= 4


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.95, sample_rows: int = 20_000, block_rows: int = 2048, query_rows: int = 256, exact_rows: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of ``vectors`` (vec_id, embedding) for each of ``queries`` (same columns)."""
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    asked = clean(queries).groupBy("vec_id").agg(F.min("v").alias("q")).withColumnRenamed("vec_id", "query_id")
    asked = asked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id")  # few rows, much work: not to be coalesced
    with temporary(spark) as keep:
        entries = written(distinct_vectors(clean(vectors), k + 1), "vectors")
        whole = F.col("size") * _GROUPS + _WHOLE
        held, routed, indexes = [], [], {}
        for size, n in entries.groupBy(F.size("v").alias("size")).count().where(F.col("count") > exact_rows).collect():
            index, share = fit(entries.where(F.size("v") == size), n, sample_rows, recall)
            index.groups = min(len(index.books[0]), -(-n // block_rows))
            indexes[size] = index
            placed = written(_placed(entries, index), "placed")
            index.counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
            held.append(placed)
            routed.append(_routed(asked, index, max(k + 1, math.ceil(share * n))))
        small = ~F.col("size").isin(list(indexes)) if indexes else F.lit(True)
        rest = entries.withColumn("size", F.size("v").cast("long")).where(small)
        held.append(rest.select(whole.alias("grp"), F.lit(None).cast("long").alias("cell"), "v", "ids"))
        rest = asked.withColumn("size", F.size("q").cast("long")).where(small)
        routed.append(rest.select("query_id", "q", whole.alias("grp"), F.lit(None).cast("double").alias("reach")))

        held = written(reduce(DataFrame.unionByName, held), "held")
        sizes = written(held.groupBy("grp").agg(F.count("*").alias("n")), "sizes")  # 256 rows a dimension at most
        blocks = held.join(F.broadcast(sizes), "grp").withColumn("block", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / block_rows)))
        blocks = blocks.groupBy("grp", "block").agg(F.collect_list(F.struct("cell", "v", "ids")).alias("held"))
        routed = written(reduce(DataFrame.unionByName, routed), "asked")
        loads = written(routed.groupBy("grp").agg(F.count("*").alias("n")), "loads")
        parts = routed.join(F.broadcast(loads), "grp").withColumn("part", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("n") / query_rows)))
        parts = parts.groupBy("grp", "part").agg(F.collect_list(F.struct("query_id", "q", "reach")).alias("queries"))

        def rank(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[int, int, float]] = []
            for entries_of, questions_of in zip(batch.column(0), batch.column(1), strict=True):
                rows, questions = entries_of.values, questions_of.values
                x, ids = _matrix(rows.field("v")), rows.field("ids")
                q, names = _matrix(questions.field("q")), questions.field("query_id").to_pylist()
                if index := indexes.get(x.shape[1]):
                    first, second = np.divmod(rows.field("cell").to_numpy(zero_copy_only=False), len(index.books[1]))
                    a, b = index.distances(q)
                    reach = questions.field("reach").to_numpy(zero_copy_only=False)
                    wanted = a[:, first] + b[:, second] <= (reach + 1e-9 * np.abs(reach))[:, None]
                for i, name in enumerate(names):
                    at = np.flatnonzero(wanted[i]) if index else np.arange(len(x))
                    if len(at):
                        out += [(name, v, s) for s, v in _best(q[i], name, x[at], ids.take(pa.array(at)), k)]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

        found = map_batches(blocks.join(parts, "grp").select("held", "queries"), rank, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return keep(written(found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "nearest"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
