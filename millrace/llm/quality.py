"""Quality classifier: naive Bayes features in a support vector machine.

Texts become indicators of hashed byte n-grams (1 to 4 bytes) and of word 5-grams that repeat. Each
indicator is scaled by the log ratio of its smoothed shares in good and bad texts, rows are scaled
to length one, and a linear hinge-loss model is fitted by dual coordinate descent. The margin
becomes a score by a logistic curve fitted on margins of rows that the model has not seen.

Ratios, model and curve take at most ``sample_rows`` labelled rows (by hash of the id, the
documented bound). The weights (2^17 floats) are all that is broadcast; scoring covers whole texts,
without a shuffle.

Defined cases: null, empty and blank texts have no indicators and get the score of the constant
alone; repeated rows repeat their result; without labelled rows of both kinds every score is 1;
a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fold, labelled_sample, logistic, map_batches, table

BITS = 17
ORDERS = (1, 2, 3, 4)
_MULTIPLIERS = {k: 0x9E3779B1 + 2 * 7919 * k for k in ORDERS}


def indicators(text: str | None) -> np.ndarray:
    """Sorted hashed indices of the n-grams that occur; indices 0 to 15 tell how much of the text repeats."""
    raw = (text or "").encode()
    flags = np.zeros(1 << BITS, bool)
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    for k in ORDERS:
        n = len(data) - k + 1
        if n <= 0:
            break
        h = np.zeros(n, np.uint32)
        for j in range(k):
            h = h * np.uint32(257) + data[j : n + j]
        h *= np.uint32(_MULTIPLIERS[k] & 0xFFFFFFFF)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        flags[h >> np.uint32(32 - BITS)] = True
    flags[:16] = False
    words = raw.split()
    if len(words) > 5:
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.uint64, len(words))
        n = len(ids) - 4
        h = np.zeros(n, np.uint64)
        for j in range(5):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : n + j] + np.uint64(1)
        h.sort()
        repeated = (h[1:] == h[:-1]).sum() / n
        flags[: int(np.ceil(repeated * 16))] = True
    return np.flatnonzero(flags)


@dataclass
class Model:
    weights: np.ndarray  # of indicators, scaling included
    constant: float
    slope: tuple[float, float]  # of the logistic curve: constant, factor

    def score(self, text: str | None) -> float:
        at = indicators(text)
        margin = self.constant + (float(self.weights[at].sum()) / float(np.sqrt(max(1, len(at)))) if len(at) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(self.slope[0] + self.slope[1] * margin, -50, 50))))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of each indicator's smoothed share among good rows over that among bad rows."""
    counts = []
    for kind in (1, 0):
        n = np.full(1 << BITS, alpha)
        for x, label in zip(rows, y, strict=True):
            if label == kind:
                n[x] += 1
        counts.append(n / n.sum())
    return np.log(counts[0] / counts[1])


def dual_coordinate_descent(rows: list[np.ndarray], ratios: np.ndarray, y: np.ndarray, costs: np.ndarray, rounds: int = 12, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights over scaled indicators and the constant of the linear hinge-loss machine. A row's parts are ratio / sqrt(indicators)."""
    w, constant = np.zeros(len(ratios)), 0.0
    scale = np.array([1 / np.sqrt(max(1, len(x))) for x in rows])
    norm = np.array([1 + float((ratios[x] ** 2).sum()) * s * s for x, s in zip(rows, scale, strict=True)])
    alpha, sign, rng = np.zeros(len(rows)), np.where(y == 1, 1.0, -1.0), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            x = rows[i]
            part = ratios[x] * scale[i]
            g = sign[i] * (float(w[x] @ part) + constant) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), costs[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[x] += step * sign[i] * part
                constant += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, constant


def fit_quality(docs: DataFrame, labels: DataFrame, keep=None, sample_rows: int = 5000, cost: float = 1.0) -> Model:
    """From at most ``sample_rows`` labelled rows: four fifths for ratios and machine, a fifth for the curve."""
    sample = labelled_sample(docs, labels, "quality", sample_rows, keep).select("doc_id", "text", "y")

    def featurise(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = [indicators(t).astype(np.int32) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "x", "y"])

    found = map_batches(sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "y"), featurise, "doc_id long, x array<int>, y int").toArrow()
    rows = sorted(((zlib.crc32(str(d).encode() + b"half"), d, len(x), x, y) for d, x, y in zip(found["doc_id"].to_pylist(), (np.asarray(v.values) for v in found["x"]), found["y"].to_pylist(), strict=True)), key=lambda r: r[:3])
    own, other = [r for r in rows if r[0] % 5], [r for r in rows if not r[0] % 5]
    if len({r[4] for r in own}) < 2 or len({r[4] for r in other}) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, (50.0, 0.0))
    x, y = [r[3] for r in own], np.array([r[4] for r in own])
    ratios = log_count_ratios(x, y)
    rare = len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))
    w, constant = dual_coordinate_descent(x, ratios, y, cost * rare[y])
    model = Model((w * ratios).astype(np.float32), constant, (0.0, 1.0))
    margins = np.array([[constant + float(model.weights[r[3]].sum()) / np.sqrt(max(1, r[2]))] for r in other])
    model.slope = tuple(logistic(margins, np.array([r[4] for r in other], float)).tolist())
    return model


def score_documents(docs: DataFrame, model: Model, score_name: str = "score") -> DataFrame:
    """The rows and columns of ``docs`` with their score in a column of its own; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([own.score(t) for t in batch.column(at).to_pylist()], pa.float64())], names=[*names, score_name])

    return map_batches(docs, score, StructType([*docs.schema.fields, StructField(score_name, DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, keep=None, **how) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``."""
    model = fit_quality(docs, labels, keep, **how)
    name = "score"
    while name in docs.columns:
        name += "_"
    return score_documents(docs, model, name).where(F.col(name) >= least).drop(name)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
