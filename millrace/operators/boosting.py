"""Second-order boosting of regression trees on histograms, level by level or leaf by leaf, as a Spark ML estimator.

Features become bin numbers once, by quantile sketches. Rows of the same bins get the same predictions, so one shuffle makes groups of
them, with their number and the sum of their labels, and passes read groups; blocks of these are fixed in the shared folder, and predictions
travel with them, cut from their lineage every few trees. A pass over the blocks sums gradients and counts for each (node, feature, bin) of the
nodes that are asked for; partitions merge by ``treeAggregate``, and histograms are all that the driver gets. Of two
children only the smaller one is summed, the other is its parent less that.

A tree that learns from a share of the rows has numbers and sums of its own. Which rows these are doesn't depend on the trees before it: with
few groups, one pass sums them for all trees; with more, blocks keep single rows, and each pass draws anew.

Labels and predictions are whole numbers (a fixed share of the largest gradient at the start), and so are gradients: sums don't depend on
groups, partitions or their order, and a lost executor changes no split.

Growing by leaves splits the leaf of the highest gain first. The children of every leaf that may still be split are summed in one
pass, so a tree takes about as many passes as it is deep; the order of splits is that of one leaf at a time.

Defined cases: a missing value (null, NaN) has a bin of its own, and each split sends it where the gain is higher; a feature without two
different values is never split; a table without rows is refused.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fixed

#: Rows of a block at most; whole-number gradients of so many rows add up exactly in a float's 53 bits.
BLOCK_ROWS, GRADIENT_BITS = 1 << 16, 28
#: Groups times trees, at most, whose sums of drawn rows one task holds (16 bytes each).
DRAWN = 1 << 22


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``leaves`` 0: level by level down to ``depth``; else leaf by leaf up to so many. ``least_weight`` and
    ``least_rows`` hold for each child."""

    trees: int = 300
    depth: int = 6
    leaves: int = 0
    rate: float = 0.1
    ridge: float = 1.0
    least_gain: float = 0.0
    least_rows: int = 1
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = 255
    seed: int = 42


@dataclass
class Tree:
    """Nodes as columns; ``feature`` -1 marks a leaf. Bins up to ``bin`` go left, missing values if ``missing_left``."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(x)
        return len(self.feature) - 1

    def route(self, lower: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], rows: int) -> np.ndarray:
        """The leaf of each row; ``lower(at, feature, node)`` tells which rows go left."""
        node = np.zeros(rows, np.int64)
        columns = [np.asarray(x) for x in (self.feature, self.left, self.right)]
        at = np.arange(rows)
        while True:
            feature = columns[0][node[at]]
            at, feature = at[feature >= 0], feature[feature >= 0]
            if not len(at):
                return node
            goes_left = lower(at, feature, node[at])
            node[at] = np.where(goes_left, columns[1][node[at]], columns[2][node[at]])

    def leaf_of_bins(self, bins: np.ndarray, missing: int) -> np.ndarray:
        cut, missing_left = np.asarray(self.bin), np.asarray(self.missing_left)

        def lower(at, feature, node):
            x = bins[at, feature]
            return np.where(x == missing, missing_left[node], x <= cut[node])

        return self.route(lower, len(bins))

    def predict(self, values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        """Of raw values, by the upper ends of bins."""
        limit = np.array([np.inf if f < 0 or b >= len(cuts[f]) else cuts[f][b] for f, b in zip(self.feature, self.bin, strict=True)])
        missing_left = np.asarray(self.missing_left)

        def lower(at, feature, node):
            x = values[at, feature]
            return np.where(np.isnan(x), missing_left[node], x <= limit[node])

        return np.asarray(self.value)[self.route(lower, len(values))]


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool


def best_split(grad: np.ndarray, rows: np.ndarray, columns: np.ndarray, growth: Growth, scale: float) -> Split | None:
    """The split of the highest gain of one node's histograms (feature, bin; the last bin: missing); ties go to the first feature and
    bin, and to the right for missing values. Sums are whole numbers."""
    g, n = grad[columns], rows[columns]
    whole_g, whole_n = g.sum(axis=1)[:, None], n.sum(axis=1)[:, None]
    below_g, below_n = np.cumsum(g[:, :-1], axis=1), np.cumsum(n[:, :-1], axis=1)
    score = lambda g, n: (g * scale) ** 2 / np.maximum(n + growth.ridge, 1e-12)
    best: Split | None = None
    for missing_left in (False, True):
        left_g, left_n = (below_g + g[:, -1:], below_n + n[:, -1:]) if missing_left else (below_g, below_n)
        right_g, right_n = whole_g - left_g, whole_n - left_n
        gain = 0.5 * (score(left_g, left_n) + score(right_g, right_n) - score(whole_g, whole_n))
        allowed = (left_n >= growth.least_rows) & (right_n >= growth.least_rows) & (gain > growth.least_gain + 1e-10 * score(whole_g, whole_n))
        gain = np.where(allowed, gain, -np.inf)
        at = int(np.argmax(gain))
        f, b = divmod(at, gain.shape[1])
        if gain[f, b] > (best.gain if best else 0):
            best = Split(float(gain[f, b]), int(columns[f]), b, missing_left)
    return best


def whole_sums(at: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of whole numbers by place: where a float's 53 bits might not do, upper and lower halves are summed apart."""
    if not len(weights) or len(at) * max(-int(weights.min()), int(weights.max())) < 1 << 53:
        return np.bincount(at, weights, size).astype(np.int64)
    return (np.bincount(at, weights >> 31, size).astype(np.int64) << 31) + np.bincount(at, weights & ((1 << 31) - 1), size).astype(np.int64)


def histograms(bins: np.ndarray, grad: np.ndarray, rows: np.ndarray, leaf: np.ndarray, wanted: list[int], width: int) -> np.ndarray:
    """Whole-number sums of gradients, and rows, for (wanted leaf, feature, bin), from the sums and rows of each line of ``bins``."""
    place = np.full(max(int(leaf.max(initial=0)), *wanted) + 1, -1)
    place[wanted] = np.arange(len(wanted))
    slot = place[leaf]
    chosen = slot >= 0
    bins, grad, rows, slot = bins[chosen], grad[chosen], rows[chosen], slot[chosen]
    features = bins.shape[1]
    at = ((slot[:, None] * features + np.arange(features)) * width + bins).ravel()
    size = len(wanted) * features * width
    return np.stack([whole_sums(at, np.repeat(x, features), size) for x in (grad, rows)]).reshape(2, len(wanted), features, width)


def grow_tree(histograms_of: Callable[[Tree, list[int]], np.ndarray], columns: np.ndarray, growth: Growth, scale: float) -> Tree:
    """One tree; ``histograms_of(tree, leaves)`` passes over the data once."""
    tree, known, splits, level = Tree(), {}, {}, {}

    def learn(node: int, hist: np.ndarray, depth: int) -> None:
        known[node], level[node] = hist, depth
        grad, rows = hist[0, 0].sum(), hist[1, 0].sum()
        tree.value[node] = -growth.rate * float(grad) * scale / (float(rows) + growth.ridge) if rows else 0.0
        deeper = growth.leaves or depth < growth.depth
        splits[node] = best_split(*hist, columns, growth, scale) if deeper else None

    def open_node(node: int) -> tuple[int, int, int]:
        """Adds the children of a node as leaves; the smaller one, the other one and their parent."""
        s = splits[node]
        left, right = tree.add(0.0), tree.add(0.0)
        tree.feature[node], tree.bin[node], tree.missing_left[node], tree.left[node], tree.right[node] = s.feature, s.bin, s.missing_left, left, right
        rows = known[node][1, s.feature]
        n_left = rows[: s.bin + 1].sum() + (rows[-1] if s.missing_left else 0)
        return (left, right, node) if n_left * 2 <= rows.sum() else (right, left, node)

    def expand(nodes: list[int]) -> None:
        opened = [open_node(node) for node in nodes]
        if not opened:
            return
        found = histograms_of(tree, [small for small, *_ in opened])
        for k, (small, large, parent) in enumerate(opened):
            learn(small, found[:, k], level[parent] + 1)
            learn(large, known.pop(parent) - found[:, k], level[parent] + 1)

    root = tree.add(0.0)
    learn(root, histograms_of(tree, [root])[:, 0], 0)
    if not growth.leaves:
        front = [root]
        while front := [node for node in front if splits[node]]:
            first = len(tree.feature)
            expand(front)
            front = list(range(first, len(tree.feature)))
        return tree
    # leaf by leaf: the tree is opened ahead of its splits, then cut back to those that come first
    heap, chosen, leaves = [(-splits[root].gain, root)] if splits[root] else [], set(), 1
    while heap and leaves < growth.leaves:
        if tree.feature[heap[0][1]] < 0:
            ahead = [node for _, node in heapq.nsmallest(growth.leaves - leaves, heap) if tree.feature[node] < 0]
            expand(ahead)
        _, node = heapq.heappop(heap)
        chosen.add(node)
        leaves += 1
        for child in (tree.left[node], tree.right[node]):
            if splits[child]:
                heapq.heappush(heap, (-splits[child].gain, child))
    return pruned(tree, chosen)


def pruned(tree: Tree, chosen: set[int]) -> Tree:
    """The nodes that chosen splits reach; every other one is a leaf."""
    out = Tree()

    def copy(node: int) -> int:
        new = out.add(tree.value[node])
        if node in chosen:
            out.feature[new], out.bin[new], out.missing_left[new] = tree.feature[node], tree.bin[node], tree.missing_left[node]
            out.left[new], out.right[new] = copy(tree.left[node]), copy(tree.right[node])
        return new

    copy(0)
    return out


@dataclass
class Block:
    """Rows of one block: bins (row, feature), whole label, prediction so far (both from the constant)."""

    number: int
    bins: np.ndarray
    label: np.ndarray
    predicted: np.ndarray

    def rows_of(self, tree: int, growth: Growth) -> np.ndarray:
        """Rows that a tree learns from; the same ones in each pass."""
        if growth.row_share >= 1:
            return np.ones(len(self.label), bool)
        return np.random.default_rng([growth.seed, tree, self.number]).random(len(self.label)) < growth.row_share

    def histograms(self, tree: Tree, leaves: list[int], number: int, growth: Growth, scale: float, width: int) -> np.ndarray:
        chosen = self.rows_of(number, growth)
        bins, gradient = self.bins[chosen], whole(self.predicted[chosen], scale) - self.label[chosen]
        return histograms(bins, gradient, np.ones(len(bins), np.int64), tree.leaf_of_bins(bins, width - 1), leaves, width)

    def moved(self, tree: Tree, width: int) -> Block:
        return replace(self, predicted=self.predicted + np.asarray(tree.value)[tree.leaf_of_bins(self.bins, width - 1)])

    def drawn(self, growth: Growth) -> Iterator[tuple[bytes, np.ndarray]]:
        """Each group of equal bins with its rows and labels' sum for (tree)."""
        keys, group = grouped_bins(self.bins)
        out = np.zeros((len(keys), 2, growth.trees), np.int64)
        for tree in range(growth.trees):
            chosen = self.rows_of(tree, growth)
            out[:, 0, tree] = np.bincount(group[chosen], minlength=len(keys))
            out[:, 1, tree] = whole_sums(group[chosen], self.label[chosen], len(keys))
        return zip((k.tobytes() for k in keys), out, strict=True)


@dataclass
class Groups:
    """Groups of rows of equal bins: bins (group, feature), rows and sum of whole labels for (group, tree; one column if all trees learn
    from all rows), prediction so far."""

    bins: np.ndarray
    rows: np.ndarray
    total: np.ndarray
    predicted: np.ndarray

    def histograms(self, tree: Tree, leaves: list[int], number: int, growth: Growth, scale: float, width: int) -> np.ndarray:
        rows, total = (x[:, number if x.shape[1] > 1 else 0] for x in (self.rows, self.total))
        return histograms(self.bins, rows * whole(self.predicted, scale) - total, rows, tree.leaf_of_bins(self.bins, width - 1), leaves, width)

    def moved(self, tree: Tree, width: int) -> Groups:
        return replace(self, predicted=self.predicted + np.asarray(tree.value)[tree.leaf_of_bins(self.bins, width - 1)])


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    return np.rint(values / scale).astype(np.int64)


def grouped_bins(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different lines of bins, and which of them each line is."""
    lines = np.ascontiguousarray(bins).view(f"V{bins.shape[1] * bins.itemsize}").ravel()
    keys, group = np.unique(lines, return_inverse=True)
    return keys.view(bins.dtype).reshape(-1, bins.shape[1]), group.ravel()


def cut_points(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Upper ends of each feature's bins but the last, by quantile sketches."""
    columns = [f"f{k}" for k in range(features)]
    flat = rows.select(*(F.nanvl(F.col("x")[k], F.lit(None).cast("double")).alias(c) for k, c in enumerate(columns)))
    found = flat.approxQuantile(columns, [k / bins for k in range(bins + 1)], 1 / (4 * bins))
    return [np.unique(np.asarray(x, float))[:-1] for x in found]


def to_bins(values: np.ndarray, cuts: list[np.ndarray], missing: int) -> np.ndarray:
    out = np.empty(values.shape, np.uint16)
    for k, edges in enumerate(cuts):
        out[:, k] = np.where(np.isnan(values[:, k]), missing, np.searchsorted(edges, values[:, k], side="left"))
    return out


def _matrix(column: pa.Array, features: int) -> np.ndarray:
    flat = column.flatten().fill_null(np.nan) if isinstance(column, pa.ListArray) else column
    return np.asarray(flat, float).reshape(-1, features)


def blocks_of(rows: DataFrame, cuts: list[np.ndarray], missing: int, base: float, scale: float) -> DataFrame:
    """number, bins and whole labels of blocks, packed."""

    def pack(batches):
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                bins = to_bins(_matrix(part.column(0), len(cuts)), cuts, missing)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([bins.tobytes()], pa.binary()), pa.array([whole(np.asarray(part.column(1), float) - base, scale).tobytes()], pa.binary())], names=["number", "bins", "label"])
                number += 1

    return rows.select("x", "y").mapInArrow(pack, "number long, bins binary, label binary")


def groups_of(rows: DataFrame, cuts: list[np.ndarray], missing: int, base: float, scale: float) -> DataFrame:
    """bins, rows, total: the rows of equal bins and the sum of their whole labels."""

    def count(batches):
        for batch in batches:
            keys, group = grouped_bins(to_bins(_matrix(batch.column(0), len(cuts)), cuts, missing))
            total = whole_sums(group, whole(np.asarray(batch.column(1), float) - base, scale), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(np.bincount(group, minlength=len(keys))), pa.array(total)], names=["bins", "rows", "total"])

    counted = rows.select("x", "y").mapInArrow(count, "bins binary, rows long, total long")
    return counted.groupBy("bins").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))


def packed(groups: DataFrame) -> DataFrame:
    """``groups_of`` in blocks."""

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                columns = [b"".join(batch.column(0).to_pylist()), *(np.asarray(batch.column(k)).tobytes() for k in (1, 2))]
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in columns], names=["bins", "rows", "total"])

    return groups.select("bins", "rows", "total").mapInArrow(pack, "bins binary, rows binary, total binary")


class HeldRows:
    """Blocks in this process."""

    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    def histograms(self, *request) -> np.ndarray:
        return sum(block.histograms(*request) for block in self.blocks)

    def move(self, tree: Tree, width: int) -> None:
        self.blocks = [block.moved(tree, width) for block in self.blocks]


class SpreadRows:
    """Blocks of an RDD, kept with their predictions; every ``lineage`` trees these are fixed anew in the shared folder."""

    def __init__(self, blocks: RDD, lineage: int = 20):
        self.state, self.before, self.lineage, self.moves = blocks.persist(StorageLevel.MEMORY_AND_DISK), None, lineage, 0

    def histograms(self, *request) -> np.ndarray:
        add = lambda a, b: b if a is None else a if b is None else a + b
        return self.state.treeAggregate(None, lambda a, block: add(a, block.histograms(*request)), add)

    def move(self, tree: Tree, width: int) -> None:
        if self.before is not None:  # its rows have been passed on
            self.before.unpersist()
        self.before, self.state = self.state, self.state.map(lambda block: block.moved(tree, width)).persist(StorageLevel.MEMORY_AND_DISK)
        self.moves += 1
        if self.moves % self.lineage == 0:
            self.state.checkpoint()

    def free(self) -> None:
        for held in (self.before, self.state):
            if held is not None:
                held.unpersist()


def grow_trees(rows: HeldRows | SpreadRows, features: int, growth: Growth, scale: float, width: int) -> list[Tree]:
    trees = []
    for number in range(growth.trees):
        columns = np.sort(np.random.default_rng([growth.seed, number]).permutation(features)[: max(1, round(features * growth.column_share))])
        tree = grow_tree(lambda tree, leaves, number=number: rows.histograms(tree, leaves, number, growth, scale, width), columns, growth, scale)
        rows.move(tree, width)
        trees.append(tree)
    return trees


@dataclass
class Binned:
    """Rows (x, y) with what no tree changes: constant, ends of bins, width of histograms, unit of whole numbers, groups of equal bins."""

    rows: DataFrame
    count: int
    base: float
    cuts: list[np.ndarray]
    width: int
    scale: float
    groups: DataFrame
    group_count: int


def binned(rows: DataFrame, features: int, bins: int) -> Binned:
    stats = rows.agg(F.avg("y").alias("mean"), F.max("y").alias("high"), F.min("y").alias("low"), F.count("y").alias("rows")).first()
    if stats["mean"] is None:
        raise ValueError("no rows to learn from")
    base = float(stats["mean"])
    cuts = cut_points(rows, features, bins)
    width = max((len(x) for x in cuts), default=0) + 2  # and the missing one
    scale = float(2.0 ** np.ceil(np.log2(max(stats["high"] - base, base - stats["low"], 1e-300))) / 2**GRADIENT_BITS)
    groups = fixed(groups_of(rows, cuts, width - 1, base, scale))
    return Binned(rows, stats["rows"], base, cuts, width, scale, groups, groups.count())


def boost(rows: DataFrame | Binned, features: int, growth: Growth, one_task: int = BLOCK_ROWS) -> tuple[float, list[np.ndarray], list[Tree]]:
    """(constant, cuts, trees) from rows (x array<double>, y double), or from rows binned before. Up to ``one_task`` groups of equal bins,
    one task makes all passes, as a pass costs more as a job than in numbers there; sums of whole numbers give the same trees either way
    (tested)."""
    known = rows if isinstance(rows, Binned) else binned(rows, features, growth.bins)
    base, cuts, width, scale, groups, count = known.base, known.cuts, known.width, known.scale, known.groups, known.group_count
    unpack = lambda packed: np.frombuffer(packed, np.uint16).reshape(-1, features)

    def group_block(r) -> Groups:
        rows, total = (np.frombuffer(r[c], np.int64).reshape(-1, 1) for c in ("rows", "total"))
        return Groups(unpack(r["bins"]), rows, total, np.zeros(len(rows)))

    def drawn_block(found) -> Iterator[Groups]:
        while part := list(itertools.islice(found, BLOCK_ROWS)):
            sums = np.stack([x for _, x in part])
            yield Groups(unpack(b"".join(key for key, _ in part)), sums[:, 0], sums[:, 1], np.zeros(len(part)))

    def row_block(r) -> Block:
        label = np.frombuffer(r["label"], np.int64)
        return Block(r["number"], unpack(r["bins"]), label, np.zeros(len(label)))

    one = count <= one_task and (growth.row_share >= 1 or count * growth.trees <= DRAWN)
    if growth.row_share >= 1:
        blocks = packed(fewer(groups, count)).rdd.map(group_block)
    else:
        blocks = fixed(blocks_of(fewer(known.rows, known.count), cuts, width - 1, base, scale)).rdd.map(row_block)
        if one:
            drawn = blocks.flatMap(lambda block: block.drawn(growth)).reduceByKey(np.add, max(1, count * growth.trees // BLOCK_ROWS))
            blocks = drawn.coalesce(1).mapPartitions(drawn_block)
    if one:
        return base, cuts, blocks.coalesce(1).mapPartitions(lambda held: [grow_trees(HeldRows(list(held)), features, growth, scale, width)]).first()
    spread = SpreadRows(blocks)
    try:
        return base, cuts, grow_trees(spread, features, growth, scale, width)
    finally:
        spread.free()


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """In no more partitions than blocks: a task costs more than a few rows in it."""
    parts = max(1, rows // BLOCK_ROWS)
    return df.coalesce(parts) if parts < df.rdd.getNumPartitions() else df


class _Shared(HasFeaturesCol, HasPredictionCol):
    pass


class HistogramBooster(Estimator, _Shared, HasLabelCol):
    """Estimator of ``Growth`` settings; without further ones those of level-wise trees."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", growth: Growth | None = None, one_task: int = BLOCK_ROWS):
        super().__init__()
        self.growth, self.one_task = growth or Growth(), one_task
        self._set(featuresCol=featuresCol, labelCol=labelCol, predictionCol=predictionCol)

    def binned(self, dataset: DataFrame) -> Binned:
        """What boosters of as many bins share on the same columns."""
        rows = dataset.select(as_array(dataset, self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y")).dropna(subset=["y"])
        first = rows.select(F.size("x")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        return binned(rows, first[0], self.growth.bins)

    def _fit(self, dataset: DataFrame) -> BoostedTrees:
        return self.fit_binned(self.binned(dataset))

    def fit_binned(self, rows: Binned) -> BoostedTrees:
        base, cuts, trees = boost(rows, len(rows.cuts), self.growth, self.one_task)
        model = BoostedTrees()._set(featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())
        return model._set(trees=json.dumps({"base": base, "cuts": [x.tolist() for x in cuts], "trees": [vars(t) for t in trees]}))


class BoostedTrees(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """A boosted model; its trees are a parameter, so that pipelines save and load it."""

    trees = Param(Params._dummy(), "trees", "constant, upper ends of bins, and trees as JSON", TypeConverters.toString)

    def parts(self) -> tuple[float, list[np.ndarray], list[Tree]]:
        found = json.loads(self.getOrDefault(self.trees))
        return found["base"], [np.array(x, float) for x in found["cuts"]], [Tree(**t) for t in found["trees"]]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        base, cuts, trees = self.parts()

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            values = np.concatenate(x.to_numpy()).reshape(len(x), -1) if len(x) else np.zeros((0, len(cuts)))
            return pd.Series(base + sum((t.predict(values, cuts) for t in trees), np.zeros(len(values))))

        return dataset.withColumn(self.getPredictionCol(), predicted(as_array(dataset, self.getFeaturesCol())))


def as_array(df: DataFrame, column: str):
    return vector_to_array(column) if isinstance(df.schema[column].dataType, VectorUDT) else F.col(column).cast("array<double>")
