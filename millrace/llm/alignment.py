"""Tokens of two tokenizers over the same bytes: groups between common cuts, links between overlapping tokens, and how often ids meet.

Token ends of a text are bits of two packed bitsets. Their AND holds the common cuts, which part both sequences into groups; popcount
ranks map a cut to the tokens before it, so a group is a range of tokens on either side. Their OR holds every end: between two
neighbouring ends exactly one token of either side lies, and no two of these pieces show the same two tokens, so its bits are the links.

A text is encoded once, where it is read. A link's weight is a count over the corpus, so texts are gathered to blocks of about
``block_bytes``: a block states its different id pairs once with their counts, and each text refers to them by number. Pairs are summed
over blocks, the answers return to their blocks, and each block's texts add them up. A pair that every text holds is one row a block.

Defined cases: a null or empty text, and one whose pieces don't give back a space and the text (the second tokenizer knows U+2581 as its
blank), has no tokens: zeros, empty groups; repeated rows are counted each; a null doc_id is kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table, temporary, written
from .tokens import default_path, encoding

PIECES = "piece_bpe_32k.model"
BLANK = "▁"


@lru_cache(maxsize=2)
def first_tokens(path: str | None = None) -> list[bytes]:
    """Bytes of each id of the byte-level vocabulary."""
    enc = encoding(path)
    return [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


@lru_cache(maxsize=2)
def piece_model(path: str | None = None):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or default_path(PIECES))


@lru_cache(maxsize=2)
def second_tokens(path: str | None = None) -> list[bytes]:
    """Bytes of each piece: its text with the blank as a space, or the one byte that it names."""
    model = piece_model(path)
    name = model.id_to_piece
    return [bytes([int(name(i)[3:-1], 16)]) if model.is_byte(i) else name(i).replace(BLANK, " ").encode() for i in range(model.get_piece_size())]


@lru_cache(maxsize=4)
def _sizes(of, path: str | None) -> np.ndarray:
    return np.array([len(x) for x in of(path)], np.int64)


@lru_cache(maxsize=4)
def _decimals(of, path: str | None) -> np.ndarray:
    """Each id's digits with a comma, a bar or a semicolon after them."""
    return np.array([[f"{i}{mark}" for mark in ",|;"] for i in range(len(of(path)))], object)


class Bits:
    """A packed bitset with ranks by popcount."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def at(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view(np.uint64))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)

    def places(self) -> np.ndarray:
        """Places of the set bits (select of every rank)."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligned:
    """Groups and links of two token sequences over the same bytes, given their ids and sizes in bytes."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray):
        self.a, self.b = a, b
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        size = int(a_ends[-1]) + 1 if len(a) else 1
        ends_a, ends_b = Bits.at(a_ends, size), Bits.at(b_ends, size)
        cuts = Bits(ends_a.words & ends_b.words).places()
        self.a_stops, self.b_stops = ends_a.rank(cuts) + 1, ends_b.rank(cuts) + 1  # of each group
        stops = Bits(ends_a.words | ends_b.words).places()
        self.link_a, self.link_b = ends_a.rank(stops), ends_b.rank(stops)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Different id pairs of the links as one number (first id above the second's 32 bits), and how often each occurs."""
        both = (self.a[self.link_a].astype(np.int64) << 32) | self.b[self.link_b].astype(np.int64)
        return np.unique(both, return_counts=True)

    def groups(self, a_text: np.ndarray, b_text: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``."""
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, stops, others, text, mark in ((self.a, self.a_stops, np.concatenate([[0], self.b_stops[:-1]]), a_text, 1), (self.b, self.b_stops, self.a_stops, b_text, 2)):
            marks = np.zeros(len(ids), np.int64)
            marks[stops - 1] = mark
            shift = np.repeat(others, np.diff(stops, prepend=0))  # tokens of the other side that stand before
            out[np.arange(len(ids)) + shift] = text[ids, marks]
        return "".join(out.tolist())[:-1]


def align_text(text: str | None, first: str | None = None, second: str | None = None) -> Aligned | None:
    """None where the text has no tokens."""
    if not text:
        return None
    whole = " " + text
    data = whole.encode()
    a = np.asarray(encoding(first).encode_to_numpy(whole, allowed_special=set(), disallowed_special=()), np.int64)
    b = np.array(piece_model(second).encode(text, out_type=int), np.int64)
    a_bytes, b_bytes = first_tokens(first), second_tokens(second)
    if b"".join([b_bytes[i] for i in b.tolist()]) != data or b"".join([a_bytes[i] for i in a.tolist()]) != data:
        return None
    return Aligned(a, b, _sizes(first_tokens, first)[a], _sizes(second_tokens, second)[b])


TEXTS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, refs binary, times binary, pairs array<long>, counts array<long>"
_ARROW = pa.schema([(c, pa.int64()) for c in ("block", "doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string()), ("refs", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def align(docs: DataFrame, first: str | None = None, second: str | None = None, whole: bool = True, block_bytes: int = 16 << 20) -> DataFrame:
    """Rows of texts, and one row a block with its different pairs and their counts. ``refs``: where a text's pairs stand in that row, as
    differences; ``times``: how often each occurs in the text. ``groups``: as text, or (not ``whole``) their SHA-256."""

    def shown(found: Aligned) -> str:
        text = found.groups(_decimals(first_tokens, first), _decimals(second_tokens, second))
        return text if whole else hashlib.sha256(text.encode()).hexdigest()

    def block_rows(block: int, rows: list[tuple]) -> pa.RecordBatch:
        """rows: doc_id, four numbers, groups, pairs, times."""
        every = np.concatenate([np.zeros(0, np.int64), *(r[6] for r in rows)])
        pairs, refs = np.unique(every, return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, refs, np.concatenate([np.zeros(0, np.int64), *(r[7] for r in rows)]))
        edges = np.cumsum([0, *(len(r[6]) for r in rows)])
        packed = [np.diff(refs[a:b], prepend=0).astype("<u4").tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        of_texts = [pa.array([block] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(5)), pa.array([r[5] for r in rows], pa.string()), pa.array(packed, pa.binary()), pa.array([r[7].astype("<u4").tobytes() for r in rows], pa.binary())]
        of_texts = pa.RecordBatch.from_arrays([*of_texts, *(pa.nulls(len(rows), pa.list_(pa.int64())),) * 2], schema=_ARROW)
        of_block = pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.nulls(1, f.type) for f in list(_ARROW)[1:9]), pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64()))], schema=_ARROW)
        return pa.concat_batches([of_texts, of_block])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, size = TaskContext.get().partitionId() << 32, [], 0
        nothing = np.zeros(0, np.int64)
        for batch in (part for whole_batch in batches for part in sliced(whole_batch)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (found := align_text(text, first, second)) is None:
                    rows.append((doc_id, 0, 0, 0, 0, "", nothing, nothing))
                else:
                    rows.append((doc_id, len(found.a), len(found.b), len(found.a_stops), len(found.link_a), shown(found), *found.pairs()))
                size += len(text or "")
                if size >= block_bytes or len(rows) >= 50_000:
                    yield block_rows(block, rows)
                    block, rows, size = block + 1, [], 0
        if rows:
            yield block_rows(block, rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TEXTS)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, n (links corpus-wide), best: is n the highest count of the pair's second id? There is a row for each second id in the
    broadcast side: at most as many as the second vocabulary has."""
    counts = written(blocks.groupBy("pair").agg(F.sum("times").alias("n")), "pair_counts")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(second.alias("b")).agg(F.max("n").alias("highest"))
    return counts.join(F.broadcast(highest), second == F.col("b")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


WEIGHED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def weigh(texts: pa.Table, answers: pa.Table) -> pa.Table:
    """Sums of a block's answers for each of its texts."""
    if not texts.num_rows:
        return pa.table({c.split()[0]: pa.array([], pa.string() if "string" in c else pa.int64()) for c in WEIGHED.split(", ")})
    at = answers["pos"].to_numpy()
    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n[at], best[at] = answers["n"].to_numpy(), answers["best"].to_numpy()
    n_best, count_sum = [], []
    for refs, times in zip(texts["refs"].to_pylist(), texts["times"].to_pylist(), strict=True):
        own, often = np.cumsum(np.frombuffer(refs, "<u4"), dtype=np.int64), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int(best[own] @ often))
        count_sum.append(int(n[own] @ often))
    columns = {c: texts[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups": texts["groups"].cast(pa.string())}
    return pa.table(columns)


def weighed_alignment(docs: DataFrame, **settings) -> DataFrame:
    """WEIGHED: each text's alignment, with the sums that the corpus-wide counts give it."""
    with temporary(docs.sparkSession) as keep:
        found = keep(written(align(docs, **settings), "aligned"))
        blocks = found.where(F.col("pairs").isNotNull())
        blocks = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("pos", "x")).select("block", "pos", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("times"))
        answers = keep(written(blocks.select("block", "pos", "pair").join(pair_counts(blocks), "pair").select("block", "pos", "n", "best"), "answers"))
    texts = found.where(F.col("pairs").isNull()).drop("pairs", "counts")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(weigh, WEIGHED)


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weighed_alignment(table(spark, sf_dir, "documents"), whole=False)
    return found.withColumnRenamed("groups", "groups_sha256")
