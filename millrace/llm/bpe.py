"""Byte-level BPE with content-defined chunk reuse.

1. A rolling hash cuts each text into chunks at places that depend on nearby bytes alone, so
   passages that documents share yield equal chunks. Hashes of chunks are counted over all texts.
2. Chunks that stand twice or more are gathered once each and encoded once. Which they are travels
   as a Bloom filter of at most ``filter_bits`` bits; a false positive is a lone chunk encoded by
   itself, which changes nothing in the result.
3. The ids of shared chunks come back to the texts, the stretches between them are encoded in
   place, and joins are repaired: tokens near a join are dropped back to the nearest places that
   part tokens in any context (a visible ASCII character, then a blank or a line's end), and what
   lies between those places is encoded anew. The kept tokens have to end exactly there; if a
   chunk's do not, the chunk is encoded with its neighbours.

Texts move once, compressed, to meet the ids of their shared chunks; of equal texts, every chunk is
shared, so only their joins are encoded again.

Defined cases: null counts as empty, which has no ids and decodes to empty; the special token's
string in a text is that token, as in the tokenizers library; repeated rows repeat their result; a
null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, written
from .superblocks import gram_hashes
from .tokens import encode, encoding

WINDOW, LEAST, MOST = 32, 128, 4096
#: A chunk ends where so many bits of the window's hash are zero.
CUT_BITS = 9


def chunk_bounds(raw: bytes) -> list[int]:
    """0, the ends of the chunks, ascending; all at characters' edges."""
    n = len(raw)
    if n <= LEAST:
        return [0, n] if n else [0]
    data = np.frombuffer(raw, np.uint8)
    step, cuts = 1 << 20, []
    for at in range(0, max(1, n - WINDOW + 1), step):
        h = gram_hashes(data[at : at + step + WINDOW - 1], WINDOW)
        cuts.append(np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + at + WINDOW)
    bounds = [0]
    for c in [*np.concatenate(cuts).tolist(), n]:
        while c - bounds[-1] > MOST:
            bounds.append(_edge(raw, bounds[-1] + MOST))
        if c - bounds[-1] >= LEAST:
            c = _edge(raw, c)
            if c < n:
                bounds.append(c)
    return [*bounds, n]


def _edge(raw: bytes, at: int) -> int:
    """The next place that parts no character."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def safe_places(raw: bytes) -> np.ndarray:
    """Places where a token ends and another begins in any context, ascending, with both ends of the text."""
    data = np.frombuffer(raw, np.uint8)
    before, after = data[:-1], data[1:]
    inner = np.flatnonzero((before > 0x20) & (before < 0x7F) & ((after == 0x20) | (after == 0x0A))) + 1
    return np.concatenate([[0], inner, [len(raw)]])


@lru_cache(maxsize=2)
def token_bytes(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each id, and their numbers."""
    own = encoding(path)
    values = [own.decode_single_token_bytes(i) for i in range(own.n_vocab)]
    return values, np.fromiter(map(len, values), np.int64, len(values))


def assemble(raw: bytes, shared: dict[tuple[int, int], np.ndarray], path: str | None = None) -> np.ndarray:
    """Ids of a text, with ids of some of its stretches (start, end) known."""
    n = len(raw)
    if not shared:
        return encode(raw.decode(), path)
    places = safe_places(raw)
    _, sizes = token_bytes(path)
    out, done = [], 0
    for (a, b), ids in sorted(shared.items()):
        first = int(places[np.searchsorted(places, a, side="left")])
        last = int(places[np.searchsorted(places, b, side="right") - 1])
        if first >= last:
            continue
        ends = np.cumsum(sizes[ids]) + a
        i = 0 if first == a else int(np.searchsorted(ends, first)) + 1
        j = int(np.searchsorted(ends, last)) + 1
        if (i and ends[i - 1] != first) or j > len(ends) or ends[j - 1] != last:
            continue  # no agreement: encoded with its neighbours
        if first > done:
            out.append(encode(raw[done:first].decode(), path))
        out.append(ids[i:j])
        done = last
    if done < n:
        out.append(encode(raw[done:].decode(), path))
    return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)


def decode(ids: np.ndarray, path: str | None = None) -> bytes:
    values, _ = token_bytes(path)
    return b"".join([values[i] for i in ids.tolist()]).decode(errors="replace").encode()


def _hash(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk)


class Filter:
    """A Bloom filter with two bits a hash."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    def __contains__(self, h: int) -> bool:
        return all(int(self.words[bit >> 6]) >> (bit & 63) & 1 for bit in self.bits(h))

    def bits(self, h: int) -> tuple[int, int]:
        return h & int(self.mask), (h >> 32) & int(self.mask)


def _chunks(raw: bytes) -> list[tuple[int, int]]:
    bounds = chunk_bounds(raw)
    return list(zip(bounds, bounds[1:]))  # noqa: B905


def shared_filter(texts: DataFrame, filter_bits: int) -> Filter:
    """Of the chunks that occur twice or more over all texts."""

    def hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [_hash(raw[a:b]) for raw in map(str.encode, batch.column(0).to_pylist()) for a, b in _chunks(raw)]
        h, n = np.unique(np.array(found, np.uint64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    repeated = map_batches(texts.select("text"), hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    repeated = written(repeated, "shared")
    some, bits = repeated.count(), 1 << 12
    while bits < min(filter_bits, 16 * some):
        bits *= 2
    bit = F.explode(F.array(F.col("h").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))))
    rows = repeated.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
    return Filter(words)


def zipped(texts: DataFrame) -> DataFrame:
    """(doc_id, tk, z) of (doc_id, tk, text): the text's bytes compressed."""

    def squeeze(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "tk", "z"])

    return map_batches(texts, squeeze, "doc_id long, tk binary, z binary")


def unzipped(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _encode_texts(docs: DataFrame, finish: Callable[[bytes, np.ndarray], list], schema: str, types: list[tuple[str, pa.DataType]], path: str | None, filter_bits: int) -> DataFrame:
    """doc_id, then what ``finish`` makes of each row's bytes and ids."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.unhex(F.md5("text")).alias("tk"), "text")
    seen = spark.sparkContext.broadcast(shared_filter(texts, filter_bits))

    def refer(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = {}
        for tk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode()
            out |= {(tk, a, b): xxhash.xxh3_128_digest(raw[a:b]) for a, b in _chunks(raw) if _hash(raw[a:b]) in seen.value}
        cols = [*zip(*out, strict=True)] if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((*cols, list(out.values())), (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["tk", "a", "b", "chunk"])

    def gather(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {}
        for text in batch.column(0).to_pylist():
            raw = text.encode()
            found |= {xxhash.xxh3_128_digest(raw[a:b]): raw[a:b] for a, b in _chunks(raw) if _hash(raw[a:b]) in seen.value}
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["chunk", "body"])

    def encode_chunks(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [encode(x.decode(), path).astype("<u2").tobytes() for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    chunks = map_batches(texts.select("text"), gather, "chunk binary, body binary").groupBy("chunk").agg(F.first("body").alias("body"))
    chunks = written(map_batches(chunks, encode_chunks, "chunk binary, ids binary"), "chunks")
    refs = written(map_batches(texts.select("tk", "text"), refer, "tk binary, a long, b long, chunk binary").groupBy("tk", "a", "b").agg(F.first("chunk").alias("chunk")), "references")
    known = refs.join(chunks, "chunk").groupBy("tk").agg(F.collect_list(F.struct("a", "b", "ids")).alias("known"))
    known = written(known, "known")

    def put(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for z, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = unzipped(z)
            shared = {(k["a"], k["b"]): np.frombuffer(k["ids"], "<u2") for k in found or ()}
            rows.append(finish(raw, assemble(raw, shared, path)))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, (_, t) in zip(zip(*rows, strict=True), types, strict=True))], names=["doc_id", *(k for k, _ in types)])

    return map_batches(zipped(texts).join(known, "tk", "left").select("doc_id", "z", "known"), put, f"doc_id long, {schema}")


def encode_documents(docs: DataFrame, path: str | None = None, filter_bits: int = 1 << 27) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""
    return _encode_texts(docs, lambda raw, ids: [ids.astype(np.int32)], "ids array<int>", [("ids", pa.list_(pa.int32()))], path, filter_bits)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def back(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(np.array(x or [], np.int64), path).decode() for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), back, "doc_id long, text string")


def digest_documents(docs: DataFrame, path: str | None = None, filter_bits: int = 1 << 27) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the text that the ids decode to) of every row."""

    def finish(raw: bytes, ids: np.ndarray) -> list:
        return [len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, path)).hexdigest()]

    types = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _encode_texts(docs, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", types, path, filter_bits)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
