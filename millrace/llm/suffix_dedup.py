"""Removal of repeated strings with a column-wise multi-document suffix construction.

Aim: remove everything that a string of ``length`` symbols covers which also starts anywhere else.
An alphabet says what the symbols are, the bytes of a text or its words, and how long a string; with
``across``, only strings count that also stand in another text. Several alphabets share each pass.

1. Texts are gathered by content; a text found twice repeats as a whole.
2. Each text is cut into blocks (superblocks.py): equal strings have equal keys and stand at the
   same place relative to it. Only blocks whose key occurs twice can repeat; the counts of keys
   and of whole blocks come from aggregations with map-side combining.
3. Different blocks of a key are the documents of a collection. Its columns (the symbol of each
   block at one distance from the key) lie one after the other in a file and are read once, from
   right to left. Each round inserts one symbol per block: a stable sort by that symbol turns the
   order of the suffixes from the column before into the order from this one (the Burrows-Wheeler
   step), and the common prefixes follow as one plus range minima; order and prefixes of a round
   are written to a file that the next round reads. A start repeats where a neighbour shares
   ``length`` symbols. As blocks are aligned, suffixes of one column are all that have to be
   compared, so a round reads and writes as many entries as there are blocks.
4. A key with very many different blocks is dealt to several collections of about ``group_rows``
   blocks. So that strings equal across collections are found too, a collection passes on one
   entry for each different string (its digest; without a place if it repeats inside, as its
   places are known by then). Entries are merged in rounds, ``fan`` collections at a time and by
   ranges of the digest, in as many ranges as collections are merged; a string that repeats in a
   round is one entry without a place in the next. So a group holds as many entries as a
   collection has strings, and ``fan`` more for a string that very many texts hold.

Equal texts and equal blocks are told by their digests (128 bits, the key included) and don't pass
the construction. What stands between steps are tables in the shared folder, read sequentially and
dropped when the step after is written. The files of a collection are temporary ones of its task.

Defined cases: null text counts as empty; texts shorter than ``length`` keep all; matches never
cross documents; copies of a long enough text lose all of it, repeated rows likewise; with words,
what stands between two words of a removed string goes too; a null doc_id is kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, sliced, table, temporary, written
from .superblocks import GRAM, Symbols, as_bytes, as_words, joined, joined_runs, text_groups


@dataclass(frozen=True)
class Alphabet:
    split: Callable[[bytes], Symbols]
    length: int
    gram: int
    across: bool = False


def byte_strings(length: int = 400, gram: int = GRAM) -> Alphabet:
    return Alphabet(as_bytes, length, min(gram, max(1, length // 3)))


def word_passages(length: int = 50, gram: int = 16) -> Alphabet:
    """Passages of ``length`` words that another text holds too, whatever stands between the words."""
    return Alphabet(as_words, length, min(gram, max(1, length // 3)), across=True)


RUN = "tk binary, unit int, key long, bh long, start int, n int, back int"


def distinct_texts(docs: DataFrame) -> DataFrame:
    """tk (md5), text, copies: one row a text, in a table bucketed by tk, so that later joins by tk don't move texts."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", F.unhex(F.md5("text")))
    return written(texts.groupBy("tk").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "distinct_texts", bucket="tk")


def _long_enough(texts: DataFrame, alphabets: list[Alphabet]) -> DataFrame:
    return texts.where(F.octet_length("text") >= min(a.length for a in alphabets))


def count_keys(texts: DataFrame, alphabets: list[Alphabet]) -> DataFrame:
    """(unit, key): keys of an alphabet that occur twice or more over all texts."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = [t.encode() for t in batch.column(0).to_pylist()]
        cols: list[list[np.ndarray]] = [[], [], []]
        for unit, a in enumerate(alphabets):
            key, n = np.unique(np.concatenate([joined_runs(*joined(group, a.split), a.length, a.gram)[1] for _, group in text_groups(raws)]), return_counts=True)
            for col, x in zip(cols, (np.full(len(key), unit, np.int32), key, n), strict=True):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["unit", "key", "n"])

    seen = map_batches(_long_enough(texts, alphabets).select("text"), keys, "unit int, key long, n long")
    return seen.groupBy("unit", "key").agg(F.sum("n").alias("n")).where("n > 1").select("unit", "key")


def text_runs(texts: DataFrame, alphabets: list[Alphabet]) -> DataFrame:
    """RUN rows of all texts; bh tells blocks of a key apart (with the place of the key in them)."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = [t.encode() for t in batch.column(1).to_pylist()]
        owners, cols = [np.zeros(0, np.int64)], [[np.zeros(0, np.int64)] for _ in range(6)]
        for first, group in text_groups(raws):
            for unit, a in enumerate(alphabets):
                values, bounds = joined(group, a.split)
                text, key, start, n, place = joined_runs(values, bounds, a.length, a.gram)
                if not len(key):
                    continue
                back = place - start
                view, size = memoryview(values).cast("B"), values.itemsize
                ends = (start + n + a.length - 1) * size
                hashes = [xxhash.xxh3_64_intdigest(view[s:e], seed=b) for s, e, b in zip((start * size).tolist(), ends.tolist(), back.tolist(), strict=True)]
                owners.append(first + text)
                for col, x in zip(cols, (np.full(len(key), unit), key, np.array(hashes, np.uint64).view(np.int64), start - bounds[text], n, back), strict=True):
                    col.append(x)
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        arrays = [batch.column(0).take(pa.array(np.concatenate(owners))), *(pa.array(np.concatenate(c), t) for c, t in zip(cols, types, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names=["tk", "unit", "key", "bh", "start", "n", "back"])

    return map_batches(_long_enough(texts, alphabets).select("tk", "text"), cut, RUN)


class _Columns:
    """The columns of aligned blocks in a file, the rightmost first."""

    def __init__(self, blocks: list[np.ndarray], shift: np.ndarray, width: int):
        rows = np.zeros((len(blocks), width), blocks[0].dtype)
        for i, b in enumerate(blocks):
            rows[i, shift[i] : shift[i] + len(b)] = b
        self.file, self.dtype, self.rows = tempfile.TemporaryFile(), rows.dtype, len(blocks)
        np.ascontiguousarray(rows.T[::-1]).tofile(self.file)
        self.file.seek(0)

    def next(self) -> np.ndarray:
        return np.fromfile(self.file, self.dtype, self.rows)


class _Suffixes:
    """Order of the suffixes and their common prefixes, each round written after the one before was read."""

    def __init__(self):
        self.file, self.n = tempfile.TemporaryFile(), 0

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(0)
        return np.fromfile(self.file, np.int64, self.n), np.fromfile(self.file, np.int64, self.n)

    def write(self, order: np.ndarray, lcp: np.ndarray) -> None:
        self.n = len(order)
        self.file.seek(0)
        order.tofile(self.file)
        lcp.tofile(self.file)


def repeat_flags(order_near: np.ndarray, who: np.ndarray) -> np.ndarray:
    """Which of sorted strings repeat: order_near tells that a string equals the one before; ``who`` names the text of each, 0 if there
    are several. Of equal strings, all repeat if they are from two texts."""
    first = np.flatnonzero(~order_near)
    size = np.diff(np.append(first, len(order_near)))
    apart = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
    return np.repeat((size > 1) & (apart | np.logical_or.reduceat(who == 0, first)), size)


def collection_repeats(blocks: list[np.ndarray], back: np.ndarray, counts: np.ndarray, length: int, who: np.ndarray | None = None) -> np.ndarray:
    """Flags [block, start]: the string at that start also stands in another block of the collection (of another text, by ``who``).

    blocks (arrays of symbols) are aligned at their symbol ``back``; block i owns its first counts[i] starts.
    """
    m = len(blocks)
    who = np.zeros(m, np.int64) if who is None else who
    sizes = np.fromiter(map(len, blocks), np.int64, m)
    shift = int(back.max()) - back  # column of a block's first symbol
    ends = shift + sizes
    width = int(ends.max())
    columns, state = _Columns(blocks, shift, width), _Suffixes()
    flags = np.zeros((m, int(counts.max())), bool)
    entering = np.argsort(-ends, kind="stable")
    entered = 0
    for x in range(width - 1, -1, -1):
        column = columns.next()
        order, lcp = state.read()
        first = entered
        while entered < m and ends[entering[entered]] > x:
            entered += 1
        if entered > first:  # their suffix so far is empty and sorts first
            order = np.concatenate([entering[first:entered], order])
            lcp = np.concatenate([np.zeros(entered - first, np.int64), lcp])
            if entered - first < len(lcp):
                lcp[entered - first] = 0
        alive = np.flatnonzero(shift[order] <= x)
        if len(alive):
            symbol = column[order[alive]]
            turn = np.argsort(symbol, kind="stable")
            at, symbol = alive[turn], symbol[turn]
            fresh = np.zeros(len(at), np.int64)
            same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
            if len(same):
                pairs = np.empty(2 * len(same), np.int64)
                pairs[0::2], pairs[1::2] = at[same - 1] + 1, at[same] + 1
                fresh[same] = 1 + np.minimum.reduceat(np.append(lcp, 0), pairs)[0::2]
            order, lcp = order[at], fresh
            near = lcp >= length
            if near.any():
                i = order[repeat_flags(near, who[order])]
                s = x - shift[i]
                own = s < counts[i]
                flags[i[own], s[own]] = True
        state.write(order, lcp)
    return flags


_GROUP = ("unit", "key", "sub")


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` bytes that never part rows of one _GROUP; the rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in sliced(batch, most):
            if size >= most:
                last = [pc.equal(part.column(c), held[-1].column(c)[-1].as_py()) for c in _GROUP]
                n = pc.sum(pc.and_(pc.and_(last[0], last[1]), last[2])).as_py() or 0
                if n:
                    held.append(part.slice(0, n))
                    part = part.slice(n)
                if part.num_rows:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
            if part.num_rows:
                held.append(part)
                size += part.nbytes
    if held:
        yield pa.Table.from_batches(held)


_ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("bh", "<i8"), ("who", "<i8"), ("start", "<i4")])
_FOUND = pa.schema([("unit", pa.int32()), ("key", pa.int64()), ("bh", pa.int64()), ("starts", pa.list_(pa.int32())), ("subs", pa.int64()), ("part", pa.int64()), ("range", pa.int64()), ("entries", pa.binary())])
FOUND = "unit int, key long, bh long, starts array<int>, subs long, part long, range long, entries binary"


def _packed(unit: int, key: np.ndarray, subs: np.ndarray, part: np.ndarray, ranges: np.ndarray, entries: np.ndarray) -> pa.RecordBatch:
    """Entries as rows, one for each key, part and range of digests."""
    cell = (entries["h1"] % ranges.astype(np.uint64)).astype(np.int64)
    order = np.lexsort((cell, part, key))
    at = np.stack([key, part, cell])[:, order]
    first = np.flatnonzero(np.append(True, (at[:, 1:] != at[:, :-1]).any(axis=0)))
    raw, size = entries[order].tobytes(), _ENTRY.itemsize
    cuts = [*(first * size).tolist(), len(raw)]
    columns = {"unit": pa.array(np.full(len(first), unit, np.int32)), "key": pa.array(key[order[first]]), "bh": pa.nulls(len(first), pa.int64()), "starts": pa.nulls(len(first), pa.list_(pa.int32()))}
    columns |= {"subs": pa.array(subs[order[first]]), "part": pa.array(part[order[first]]), "range": pa.array(cell[order[first]]), "entries": pa.array([raw[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())}
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=_FOUND)


def _hits(unit: int, found: dict[tuple[int, int], list[int]]) -> pa.RecordBatch:
    """The starts found of each key and block."""
    return pa.RecordBatch.from_pylist([{"unit": unit, "key": k, "bh": b, "starts": s} for (k, b), s in found.items()], schema=_FOUND)


def _without_place(entries: np.ndarray) -> np.ndarray:
    out = entries.copy()
    out["bh"], out["who"], out["start"] = 0, 0, -1
    return out


def _strings(key: np.ndarray, bh: np.ndarray, who: np.ndarray, n: np.ndarray, content: list[np.ndarray], flags: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, entry) of the blocks' strings: one without a place for each that repeats inside, the others with theirs."""
    digests = []
    for k, c, m in zip(key.tolist(), content, n.tolist(), strict=True):
        view, size, seed = memoryview(np.ascontiguousarray(c)).cast("B"), c.itemsize, k & 0xFFFFFFFFFFFFFFFF
        digests += [xxhash.xxh3_128_digest(view[s * size : (s + length) * size], seed=seed) for s in range(m)]
    both = np.frombuffer(b"".join(digests), np.dtype([("h1", "<u8"), ("h2", "<u8")]))
    block = np.repeat(np.arange(len(n)), n)
    entries = np.zeros(len(block), _ENTRY)
    entries["h1"], entries["h2"], entries["bh"], entries["who"] = both["h1"], both["h2"], bh[block], who[block]
    entries["start"] = np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
    known = flags[block, entries["start"]]
    one = np.flatnonzero(known)[np.unique(both[known], return_index=True)[1]]
    return np.concatenate([block[~known], block[one]]), np.concatenate([entries[~known], _without_place(entries[one])])


def find_repeats(blocks: DataFrame, alphabets: list[Alphabet], fan: int) -> DataFrame:
    """FOUND rows for blocks (unit, key, bh, who, sub, subs, back, n, content): those with ``starts`` tell what repeats inside a collection,
    those with ``entries`` what the first round of ``merge_entries`` takes, for keys of several collections."""

    def of_unit(unit: int, part: pa.Table) -> Iterator[pa.RecordBatch]:
        a = alphabets[unit]
        key, bh, who, sub, subs, back, n = (part[c].to_numpy().astype(np.int64) for c in ("key", "bh", "who", "sub", "subs", "back", "n"))
        content = [a.split(x).values for x in part["content"].to_pylist()]
        flags = collection_repeats(content, back, n, a.length, who)
        hit = np.flatnonzero(flags.any(axis=1))
        yield _hits(unit, {(k, b): np.flatnonzero(flags[i]).tolist() for i, k, b in zip(hit.tolist(), key[hit].tolist(), bh[hit].tolist(), strict=True)})
        dealt = np.flatnonzero(subs > 1)
        if len(dealt):
            block, entries = _strings(key[dealt], bh[dealt], who[dealt], n[dealt], [content[i] for i in dealt], flags[dealt], a.length)
            of = dealt[block]
            yield _packed(unit, key[of], subs[of], sub[of] // fan, np.minimum(subs[of], fan), entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, 4 << 20):
            units = part["unit"].to_numpy()
            for u in np.unique(units).tolist():
                yield from (out for out in of_unit(u, part.filter(pa.array(units == u))) if out.num_rows)

    dealt = blocks.repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    return dealt.mapInArrow(run, FOUND)


def merge_round(packed: DataFrame, fan: int, reach: int) -> DataFrame:
    """FOUND rows of one round: the places of strings that stand twice or more among up to ``reach`` collections of a key (from two texts,
    by ``who``), and for keys of more collections the entries of the next round."""

    def merge(group: pa.Table) -> pa.Table:
        unit, key, subs, part = (group[c][0].as_py() for c in ("unit", "key", "subs", "part"))
        x = np.frombuffer(b"".join(group["entries"].to_pylist()), _ENTRY)
        x = x[np.lexsort((x["h2"], x["h1"]))]
        near = np.append(False, (x["h1"][1:] == x["h1"][:-1]) & (x["h2"][1:] == x["h2"][:-1]))
        twice = repeat_flags(near, x["who"])
        found: dict[tuple[int, int], list[int]] = {}
        places = x[twice & (x["start"] >= 0)]
        for b, s in zip(places["bh"].tolist(), places["start"].tolist(), strict=True):
            found.setdefault((key, b), []).append(s)
        out = [_hits(unit, found)]
        if subs > reach:
            left = np.concatenate([x[~twice], _without_place(x[twice & ~near])])
            same = lambda v: np.full(len(left), v, np.int64)
            out.append(_packed(unit, same(key), same(subs), same(part // fan), same(min(subs, reach * fan)), left))
        return pa.Table.from_batches(out, schema=_FOUND)

    return packed.groupBy("unit", "key", "part", "range").applyInArrow(merge, FOUND)


def merge_entries(found: DataFrame, subs: int, fan: int) -> list[DataFrame]:
    """Tables of (unit, key, bh, starts) of strings that several collections hold, one a round; ``subs`` is the most collections of a key."""
    hits, reach = [], fan
    while subs > 1:
        found = written(merge_round(found.where("entries is not null"), fan, reach), "merged")
        hits.append(found.where("starts is not null").select("unit", "key", "bh", "starts"))
        if reach >= subs:
            break
        reach *= fan
    return hits


def repeated_starts(texts: DataFrame, alphabets: list[Alphabet], group_rows: int, fan: int = 64) -> DataFrame:
    """tk and its repeated starts as (unit, run's start, n, relative starts or null for all ``n`` of the run); bucketed by tk."""
    with temporary(texts.sparkSession) as keep:
        keys = written(count_keys(texts, alphabets), "keys")  # read back, so that a hot key's part of the join can be split
        candidates = written(text_runs(texts, alphabets).join(keys, ["unit", "key"]), "candidates")
        kinds = candidates.groupBy("unit", "key", "bh").agg(F.count("*").alias("times"), F.min(F.struct("tk", "start", "n", "back")).alias("at"), F.max("tk").alias("last_tk"))
        across = F.col("unit").isin([u for u, a in enumerate(alphabets) if a.across])
        apart = F.when(across, F.col("at.tk") != F.col("last_tk")).otherwise(F.col("times") > 1)
        # a block's text, 0 for several texts or where it doesn't matter
        who = F.when(across & ~apart, F.xxhash64("at.tk")).otherwise(F.lit(0).cast("long"))
        kinds = written(kinds.select("unit", "key", "bh", "at", apart.alias("whole"), who.alias("who")), "kinds")
        per_key = written(kinds.groupBy("unit", "key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "per_key")  # read back for the same reason
        many = kinds.join(per_key, ["unit", "key"]).withColumn("subs", F.ceil(F.col("kinds") / group_rows)).withColumn("sub", F.pmod("bh", "subs"))
        cuts = ("unit", "key", "bh", "who", "sub", "subs", "start", "n", "back")
        wanted = many.select("unit", "key", "bh", "who", "sub", "subs", "at.*").groupBy("tk").agg(F.collect_list(F.struct(*cuts)).alias("cuts"))
        types = {"unit": pa.int32(), "start": pa.int32(), "n": pa.int32(), "back": pa.int32()}
        schema = pa.schema([*((c, types.get(c, pa.int64())) for c in cuts), ("content", pa.binary())])

        def contents(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                symbols = {u: alphabets[u].split(raw) for u in {c["unit"] for c in found}}
                for c in found:
                    a, b = symbols[c["unit"]].bounds(c["start"], c["start"] + c["n"] + alphabets[c["unit"]].length - 1)
                    out.append(c | {"content": raw[a:b]})
            return pa.RecordBatch.from_pylist(out, schema=schema)

        blocks = map_batches(texts.join(wanted, "tk").select("text", "cuts"), contents, "unit int, key long, bh long, who long, sub long, subs long, start int, n int, back int, content binary")
        found = written(find_repeats(blocks, alphabets, fan), "repeats")
        most = per_key.agg(F.max(F.ceil(F.col("kinds") / group_rows))).first()[0] or 1
        hits = reduce(DataFrame.unionByName, [found.where("starts is not null").select("unit", "key", "bh", "starts"), *merge_entries(found, most, fan)])
        hits = hits.groupBy("unit", "key", "bh").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
        whole = kinds.where("whole").select("unit", "key", "bh", F.lit(None).cast("array<int>").alias("starts"))
        part = kinds.where("not whole").select("unit", "key", "bh").join(hits, ["unit", "key", "bh"])
        of_text = candidates.join(whole.unionByName(part), ["unit", "key", "bh"]).groupBy("tk").agg(F.collect_list(F.struct("unit", "start", "n", "starts")).alias("runs"))
        return keep(written(of_text, "runs", bucket="tk"))


def spans_of(symbols: Symbols, hits: list[dict] | None, copies: int, length: int) -> list[tuple[int, int]]:
    """Maximal repeated stretches of a text's symbols."""
    n = len(symbols.values)
    if n < length or not hits and copies < 2:
        return []
    if copies > 1:
        return [(0, n)]
    firsts, lasts = [], []  # stretches of starts
    for h in hits:
        if h["starts"] is None:
            firsts.append(h["start"])
            lasts.append(h["start"] + h["n"] - 1)
        else:
            at = [h["start"] + x for x in h["starts"]]
            firsts += at
            lasts += at
    firsts, lasts = np.array(firsts), np.array(lasts)
    order = np.argsort(firsts, kind="stable")
    firsts, reach = firsts[order], np.maximum.accumulate(lasts[order]) + length
    fresh = np.append(True, firsts[1:] > reach[:-1])
    return list(zip(firsts[fresh].tolist(), reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(reach) - 1)].tolist(), strict=True))


def byte_spans(raw: bytes, hits: list[dict] | None, copies: int, alphabet: Alphabet, unit: int = 0) -> list[tuple[int, int]]:
    """The same as stretches of bytes; stretches that lie next to each other stay apart."""
    own = [h for h in hits or () if h["unit"] == unit]
    if not own and copies < 2:
        return []
    symbols = alphabet.split(raw)
    return [symbols.bounds(a, b) for a, b in spans_of(symbols, own, copies, alphabet.length)]


def repeat_spans(docs: DataFrame, length: int = 400, gram: int = GRAM, group_rows: int = 128, passage: int = 50, fan: int = 64) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): the distinct texts (tk, text, copies) and tk, spans (of bytes), n_bytes, kept_sha256 and passages (spans of bytes that
    ``passage`` words cover which another text or copy holds too) of each."""
    alphabets = [byte_strings(length, gram), word_passages(passage)]
    texts = distinct_texts(docs)
    starts = repeated_starts(texts, alphabets, group_rows, fan)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, sizes, digests, passages = [], [], [], []
        for text, copies, hits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            raw = text.encode()
            cut, shared = (byte_spans(raw, hits, copies, a, u) for u, a in enumerate(alphabets))
            spans.append([{"start": a, "end": b} for a, b in cut])
            sizes.append(len(raw))
            digests.append(hashlib.sha256(kept(raw, cut)).hexdigest())
            passages.append([{"start": a, "end": b} for a, b in shared])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, span), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(passages, span)], names=["tk", "spans", "n_bytes", "kept_sha256", "passages"])

    joined = texts.join(starts, "tk", "left").select("tk", "text", "copies", "runs")
    return texts, map_batches(joined, digest, "tk binary, spans array<struct<start:long,end:long>>, n_bytes long, kept_sha256 string, passages array<struct<start:long,end:long>>")


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def remove_repeats(docs: DataFrame, alphabet: Alphabet = byte_strings(), group_rows: int = 128, fan: int = 64) -> DataFrame:
    """The rows of ``docs`` with repeated strings cut out of ``text`` (a character that a cut parts is dropped) and ``n_chars``
    brought up to date where that column is there. Each different text is cut once and then meets its rows, which come without theirs."""
    texts = distinct_texts(docs)
    starts = repeated_starts(texts, [alphabet], group_rows, fan)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        left = []
        for text, copies, hits in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            raw = text.encode()
            left.append(kept(raw, byte_spans(raw, hits, copies, alphabet)).decode(errors="ignore") if hits or copies > 1 else text)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], names=["key", "cut"])

    joined = texts.join(starts, "tk", "left").select("tk", "text", "copies", "runs")
    cuts = map_batches(joined, cut, "key binary, cut string")
    names = docs.columns  # as fields of a row, whatever they are called
    rows = docs.select(F.struct(*(docs[c] for c in names if c != "text")).alias("row"), docs["text"].isNull().alias("none"), F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))).alias("key"))
    text = F.when(~F.col("none"), F.col("cut"))
    changed = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {"text": text}
    return rows.join(cuts, "key").select(*(changed.get(c, F.col("row")[c]).alias(c) for c in names))


def remove_passages(docs: DataFrame, words: int = 50) -> DataFrame:
    """The rows of ``docs`` without passages of ``words`` words or more that another text holds too; all occurrences go."""
    return remove_repeats(docs, word_passages(words))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then n_passages and n_passage_bytes: passages of 50 words or more that another document holds too, and their bytes."""
    docs = table(spark, sf_dir, "documents")
    with temporary(spark) as keep:
        _, spans = repeat_spans(docs)
        covered = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
        sums = spans.select(
            "tk",
            "n_bytes",
            covered("spans").alias("n_removed"),
            F.size("spans").cast("long").alias("n_spans"),
            "kept_sha256",
            F.size("passages").cast("long").alias("n_passages"),
            covered("passages").alias("n_passage_bytes"),
        )
        sums = keep(written(sums, "spans"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tk"))
    return ids.join(sums, "tk").drop("tk")
