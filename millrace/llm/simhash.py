"""SimHash near-duplicates with Gray-ordered hierarchical indexes.

A fingerprint sums the bits of the hashes of a text's word shingles. Fingerprints link when at
most ``most`` bits differ; components of links are the groups.

Different fingerprints are dealt to buckets by equal bits: of most + 1 parts of the bits, linked
fingerprints agree in one at least (with very many fingerprints the rule is applied again to the
rest of the bits). A bucket of very many fingerprints is dealt to pairs of its parts. Inside a
bucket, fingerprints stand in the order of their Gray ranks; neighbours form nodes, nodes form
upper nodes; each node holds the bits that all its members share and that its upper node does not
hold yet. A search goes down from the roots, adds up the differences from the shared patterns and
drops a whole group as soon as they exceed ``most``. A bucket returns a spanning forest of its
links, not its pairs; components of the forests are found in rounds over tables.

Defined cases: null and empty texts, and texts of blanks, have fingerprint zero and link like any
other; fewer words than a shingle form one shingle; repeated rows and equal texts share a
component; a null doc_id is kept but never names a component, whose id is null only if all its ids
are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table, temporary, written
from .components import connected

FAN = 8


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit fingerprint: bit set if set in over half the shingles' hashes (XXH64, seed 42)."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(parts) - words + 1)
    view, h = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter((h(view[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, with_digest: bool = False) -> DataFrame:
    """doc_id and fp (its 64 bits as a long) of every row, and tk, the text's md5, where asked for."""

    def sign(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *batch.schema.names[2:]])

    tk = [F.md5(F.coalesce("text", F.lit(""))).alias("tk")] if with_digest else []
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *tk), sign, "doc_id long, fp long" + ", tk string" * with_digest)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code word in the Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (bucket, Gray rank). Node: range of the level below, shared bits, pattern."""

    def __init__(self, fp: np.ndarray, bucket_starts: np.ndarray):
        self.fp, n = fp, len(fp)
        sizes = np.diff(np.append(bucket_starts, n))
        self.bucket = np.repeat(np.arange(len(sizes)), sizes)
        #: level 0: the fingerprints themselves, all bits shared
        self.levels = [{"first": np.arange(n), "last": np.arange(1, n + 1), "mask": np.full(n, ~np.uint64(0)), "pattern": fp}]
        starts, counts = bucket_starts, sizes
        item_first = np.arange(n)
        while counts.max(initial=1) > 1:
            nodes = -(-counts // FAN)
            base = np.repeat(starts, nodes)
            k = np.arange(nodes.sum()) - np.repeat(np.cumsum(nodes) - nodes, nodes)
            first = base + k * FAN
            last = np.minimum(first + FAN, np.repeat(starts + counts, nodes))
            item_first = item_first[first]
            ends = np.append(item_first[1:], n)
            width = ends - item_first
            unlike = np.bitwise_or.reduceat(fp ^ np.repeat(fp[item_first], width), item_first)
            mask = ~unlike
            self.levels.append({"first": first, "last": last, "mask": mask, "pattern": fp[item_first] & mask})
            starts, counts = np.cumsum(nodes) - nodes, nodes
        self.tops = starts  # one root a bucket

    def links(self, most: int, chunk: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j of one bucket with at most ``most`` differing bits."""
        for at in range(0, len(self.fp), chunk):
            query = np.arange(at, min(at + chunk, len(self.fp)))
            node = self.tops[self.bucket[query]]
            top = self.levels[-1]
            off = np.bitwise_count((self.fp[query] ^ top["pattern"][node]) & top["mask"][node]).astype(np.int64)
            for upper, lower in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
                n = upper["last"][node] - upper["first"][node]
                child = np.repeat(upper["first"][node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                query, off, held = np.repeat(query, n), np.repeat(off, n), np.repeat(upper["mask"][node], n)
                fresh = lower["mask"][child] & ~held
                off = off + np.bitwise_count((self.fp[query] ^ lower["pattern"][child]) & fresh)
                stays = off <= most
                query, off, node = query[stays], off[stays], child[stays]
            later = node > query
            yield query[later], node[later]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest reachable item of each item."""
    label = np.arange(n)
    for i, j in links:
        while True:
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            while (label != label[label]).any():
                label = label[label]
            if (label[i] == label[j]).all():
                break
    return label


def masks(most: int, depth: int, bits: tuple[int, ...] = tuple(range(64))) -> list[int]:
    """Bit masks (as signed longs) of which linked fingerprints agree on one at least; depth says how often the rest is parted again."""
    out = []
    for part in np.array_split(np.array(bits), most + 1):
        own = sum(1 << int(b) for b in part)
        if depth > 1:
            rest = tuple(b for b in bits if b not in set(part.tolist()))
            out += [own | (m & (2**64 - 1)) for m in masks(most, depth - 1, rest)]
        else:
            out.append(own)
    return [m - 2**64 if m >= 2**63 else m for m in out]


def _depth(n: int, most: int) -> int:
    """Times that bits are parted, so that buckets of unlike fingerprints stay small."""
    bits, held, depth = 64, 0, 0
    while depth < 4:
        held += (bits - held) // (most + 1)
        depth += 1
        if n >> held <= 256:
            break
    return depth


def link_edges(prints: DataFrame, most: int, part_rows: int = 1024) -> DataFrame:
    """(a, b): a spanning forest, bucket by bucket, of the links between different fingerprints (column fp, distinct)."""
    n = prints.count()
    keys = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks(most, _depth(n, most)))]
    rows = written(prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.*"), "buckets")
    sizes = rows.groupBy("k", "v").agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = written(sizes.withColumn("parts", F.ceil(F.col("rows") / part_rows).cast("int")), "sizes")
    part = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    # a bucket of several parts: each pair of parts meets in one group, each part with itself in those pairs
    dealt = rows.join(sizes, ["k", "v"]).withColumn("part", part).withColumn("other", other)
    dealt = dealt.where((F.col("other") != F.col("part")) | (F.col("parts") == 1)).select("fp", F.xxhash64("k", "v", F.least("part", "other"), F.greatest("part", "other")).alias("group"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, group in _whole_groups(batches):
            order = np.lexsort((gray_rank(fp), group))
            fp, group = fp[order], group[order]
            index = GrayIndex(fp, np.flatnonzero(np.append(True, group[1:] != group[:-1])))
            label = forest(len(fp), index.links(most))
            moved = np.flatnonzero(label != np.arange(len(fp)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(fp[label[moved]].view(np.int64))], names=["a", "b"])

    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(find, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(fp, group) arrays of about ``most`` rows or more that never part a group; rows come sorted by it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column("fp").to_numpy().view(np.uint64), batch.column("group").to_numpy()))
        if sum(len(g) for _, g in held) < most:
            continue
        fp, group = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(group, group[-1], side="left"))
        if cut:
            yield fp[:cut], group[:cut]
        held = [(fp[cut:], group[cut:])]
    if held and sum(len(g) for _, g in held):
        fp, group = (np.concatenate(x) for x in zip(*held, strict=True))
        yield fp, group


def groups_of(prints: DataFrame, most: int = 4) -> DataFrame:
    """(fp, component_id) of the different fingerprints of a table with doc_id and fp: the smallest doc_id of each group."""
    with temporary(prints.sparkSession) as keep:
        distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
        roots = connected(link_edges(distinct.select("fp"), most))
        rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
        rooted = written(rooted, "rooted")
        least = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
        return keep(written(rooted.join(least, "root").select("fp", "root", "component_id"), "named"))


def near_duplicates(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of the group) of every row."""
    prints = written(fingerprints(docs, words), "fingerprints")
    return prints.join(groups_of(prints, most), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 4, most: int = 4) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest doc_id (null last, then the smallest
    digest of the text); of rows equal in both, any one."""
    tk = F.md5(F.coalesce(F.col("text"), F.lit("")))
    with temporary(docs.sparkSession) as keep:
        signed = fingerprints(docs.select("doc_id", "text"), words, with_digest=True)
        prints = written(signed, "fingerprints")
        rows = prints.join(groups_of(prints, most), "fp").groupBy("root", "doc_id", "tk").agg(F.count("*").alias("times"))
        rows = written(rows, "rows")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
        first = written(rows.groupBy("root").agg(F.min(order).alias("first")), "first")
        kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tk") == F.col("first.tk"))
        away = rows.join(first, "root").where(~kept | (F.col("times") > 1)).select(F.col("doc_id").alias("away_id"), F.col("tk").alias("away_tk"), kept.alias("kept"))
        away = keep(written(away, "away"))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), tk.alias("tk"))  # columns as fields, whatever they are called
    same = F.col("id").eqNullSafe(F.col("away_id")) & (F.col("tk") == F.col("away_tk"))
    once = whole.join(away.hint("merge"), same, "left_anti")  # grows with the documents, so texts move at every size alike
    repeated = whole.join(away.where("kept"), same, "left_semi").dropDuplicates(["id", "tk"])
    return once.unionByName(repeated).select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
