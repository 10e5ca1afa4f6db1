"""Vector best-fit packing of token pieces into sequences.

A sequence (bin) has three residual capacities: tokens, documents and attention cost (the sum of
squared piece lengths, what attention inside pieces costs). Pieces come by falling size; each goes
to the bin that holds it under every constraint and scores best, either by the smallest norm of
the weighted residual or by the largest weighted dot product of need and residual.

Texts are tokenized where they are read; only piece rows (a few dozen bytes) are shuffled. Pieces
are dealt by hash to shards of about ``shard_rows`` pieces, the number of shards follows the
number of pieces, and each shard is packed on its own: at most one poorly filled bin a shard.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each for
itself; an empty table gives no pieces; equal lengths are ordered by (doc_id, piece); a null
doc_id is kept; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, written
from .tokens import encode

END = 0


def piece_bounds(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: full pieces, the first may be shorter."""
    count = max(1, -(-n // size))
    first = n - size * (count - 1)
    return [(0, first)] + [(first + size * i, size) for i in range(count - 1)]


def cut_documents(docs: DataFrame, size: int = 2048, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document; ids are those of the text, then the end token."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, piece, start, length, crc = [], [], [], [], []
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(encode(text or "", path), np.uint32(END)).astype("<u4")
            for k, (at, n) in enumerate(piece_bounds(len(ids), size)):
                doc.append(d)
                piece.append(k)
                start.append(at)
                length.append(n)
                crc.append(zlib.crc32(ids[at : at + n].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def vector_best_fit(lengths: np.ndarray, tokens: int, most_docs: int, most_cost: float, weights=(1.0, 0.05, 0.1), by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths have to come by falling size. Needs and residuals are shares of the capacities."""
    capacity = np.array([tokens, most_docs, most_cost], float)
    w = np.asarray(weights, float)
    need_of = lambda n: np.array([n, 1.0, float(n) * n]) / capacity
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = np.ones((256, 3))
    ids = np.zeros(256, np.int64)  # of the open bins
    used = np.zeros(256, np.int64)
    open_, made, least = 0, 0, lengths.min() if len(lengths) else 0
    floor = need_of(least) - 1e-12
    for i, n in enumerate(lengths):
        need = need_of(n)
        at = -1
        if open_:
            rest = left[:open_] - need
            fits = (rest >= -1e-12).all(axis=1)
            if fits.any():
                score = (left[:open_] * need * w).sum(axis=1) if by == "dot" else -(rest * rest * w).sum(axis=1)
                at = int(np.argmax(np.where(fits, score, -np.inf)))
        if at < 0:
            if open_ == len(left):
                left, ids, used = np.vstack([left, np.ones_like(left)]), np.append(ids, ids * 0), np.append(used, used * 0)
            at, open_ = open_, open_ + 1
            left[at], ids[at], used[at] = 1.0, made, 0
            made += 1
        bins[i], offsets[i] = ids[at], used[at]
        left[at] -= need
        used[at] += n
        if (left[at] < floor).any():  # not even the smallest piece fits: closed, the last open bin takes its row
            open_ -= 1
            left[at], ids[at], used[at] = left[open_], ids[open_], used[open_]
    return bins, offsets


def pack_pieces(pieces: DataFrame, size: int = 2048, most_docs: int | None = None, most_cost: float | None = None, shard_rows: int = 16384, by: str = "norm") -> DataFrame:
    """Adds sequence_id and offset. By default the caps on documents and attention cost are those that ``size`` tokens can't exceed."""
    most_docs, most_cost = most_docs or size, most_cost or float(size) * size
    rows = pieces.count()
    shards = max(1, -(-rows // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))

    def pack(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = vector_best_fit(shard["length"].to_numpy(), size, most_docs, most_cost, by=by)
        ids = bins * shards + shard["shard"].to_numpy()
        return shard.drop_columns(["shard"]).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return dealt.groupBy("shard").applyInArrow(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = 2048, path: str | None = None, **limits) -> DataFrame:
    return pack_pieces(written(cut_documents(docs, size, path), "pieces"), size, **limits)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
