"""A manifest of a dataset as a tree of SHA-256 digests: one root for all documents, and for each document the siblings that prove it.

Leaves of a language ascend by doc_id; ``FAN`` consecutive nodes become one, level by level, until one is left, the language's subroot;
subroots, by language, likewise give the root. Ranks come from one range sort: rows are numbered where they lie, and ranges add what
stands before them. A block of ``FAN ** levels`` consecutive nodes starts at a multiple of its size, so its nodes have no sibling in
another block below its own root. Each block is one group of Arrow rows, in which DuckDB runs a level as one ordered ``string_agg`` with
``sha256``. The blocks' roots are the next round's nodes, 4096 times fewer, so the rounds are the logarithm of the rows. Then proofs come
down: a block meets the path above its root, once, and its nodes add their own levels. No task holds more than a block.

A path is text: for each level, from the leaf up, the siblings to the left, ``|``, those to the right, ``;``. ``folded`` recomputes a
root from a leaf and its path with Spark's own functions.

Defined cases: null fields are ``-``; a null lang is a language of its own and comes first; a null doc_id comes first in its language;
rows that tie in doc_id are ordered by leaf, and equal rows are leaves each; an empty table has an empty manifest; other columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, table, temporary, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that become one; levels of a block, unless said otherwise; digits of a digest.
FAN, LEVELS, HEX = 8, 4, 64


def field(value: Column) -> Column:
    """UTF-8 bytes of a value, a colon, the value; or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(**instead: Column) -> Column:
    return F.sha2(F.concat(*(field(instead.get(c, F.col(c))) for c in FIELDS)), 256)


def height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    pair = lambda level: F.split(level, r"\|")
    levels = F.filter(F.split(path, ";"), lambda level: level != "")
    return F.aggregate(levels, leaf, lambda node, level: F.sha2(F.concat(F.get(pair(level), F.lit(0)), node, F.get(pair(level), F.lit(1))), 256))


def ranked(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds i, the place from 0 by ``order`` in a group, and n, the group's rows. Equal rows may lie in several ranges."""
    spark = nodes.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = written(nodes.withColumn("origin", F.spark_partition_id()), "nodes")  # fixed, as ranges are sampled and then filled
    dealt = nodes.repartitionByRange(ranges, group, *order, "origin").sortWithinPartitions(group, *order).drop("origin")
    placed = written(dealt.withColumn("place", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("place", 33))
    parts = placed.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy(group)  # as many rows as there are ranges
    before = F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(group, "part", "first", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(whole).alias("n"))
    return placed.join(parts, [group, "part"]).withColumn("i", F.col("place") - F.col("first") + F.col("before")).drop("place", "part", "first", "before")


@lru_cache(maxsize=1)
def engine():
    """DuckDB of this worker."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})


def run_sql(sql: str, nodes: pa.Table, values: list[str] = ()) -> pa.Table:
    con = engine()
    con.register("nodes", nodes)
    try:
        return con.sql(sql, params=list(values)).to_arrow_table()
    finally:
        con.unregister("nodes")


def _levels_here(nodes: pa.Table, levels: int) -> int:
    return min(levels, height(nodes["n"][0].as_py()))


def _runs(levels: int) -> list[str]:
    """Common table expressions: run_k has the joined digests of each run of level k."""
    of = lambda k: ("i", "h", "nodes") if k == 0 else ("p", "sha256(run)", f"run_{k - 1}")
    return [f"run_{k} AS MATERIALIZED (SELECT {i} // {FAN} AS p, string_agg({h}, '' ORDER BY {i}) AS run FROM {source} GROUP BY 1)" for k in range(levels) for i, h, source in [of(k)]]


def block_roots(most: int):
    """A function that gives the root of a block of ``most`` levels, and how many blocks its group has."""

    def root_of(block: pa.Table) -> pa.Table:
        levels = _levels_here(block, most)
        root = block["h"][0].as_py()
        if levels:
            root = run_sql(f"WITH {', '.join(_runs(levels))} SELECT sha256(run) FROM run_{levels - 1}", block.select(["i", "h"]))[0][0].as_py()
        blocks = -(-block["n"][0].as_py() // FAN**most)
        return pa.table({"grp": block["grp"][:1].cast(pa.string()), "i": pa.array([block["block"][0].as_py()], pa.int64()), "n": pa.array([blocks], pa.int64()), "h": pa.array([root], pa.string())})

    return root_of


def _walk(levels: int, shown: str = "h") -> str:
    """Common table expressions that end in walk: node, h (``shown`` folded up to the block's root), path."""
    steps = [*_runs(levels), f"walk_0 AS (SELECT i AS node, i, {shown} AS h, '' AS path FROM nodes)"]
    for k in range(levels):
        at = f"CAST(i % {FAN} AS INTEGER)"
        sides = f"SELECT w.node, w.i // {FAN} AS i, w.path, substr(run, 1, {HEX} * {at}) AS l, substr(run, {HEX} * {at} + {HEX + 1}) AS r, w.h FROM walk_{k} w JOIN run_{k} ON p = w.i // {FAN}"
        steps.append(f"walk_{k + 1} AS (SELECT node, i, sha256(l || h || r) AS h, path || l || '|' || r || ';' AS path FROM ({sides}))")
    return f"WITH {', '.join(steps)}, walk AS (SELECT * FROM walk_{levels})"


def block_paths(most: int):
    """A function that gives the paths of a block's nodes, given the one of its root."""

    def paths_of(block: pa.Table, above: pa.Table) -> pa.Table:
        found = run_sql(f"{_walk(_levels_here(block, most))} SELECT node, path || ? FROM walk", block.select(["i", "h"]), [above["path"][0].as_py()])
        return pa.table({"grp": pa.array([block["grp"][0].as_py()] * len(found), pa.string()), "i": found[0].cast(pa.int64()), "path": found[1].cast(pa.string())})

    return paths_of


PROVED = "doc_id long, leaf string, subroot string, root string, path string, proof_sha256 string, folded_root string"


def block_proofs(most: int, whole: bool):
    """A function that gives a block's leaves their proofs; ``told`` is the leaf that somebody shows, folded up the path."""
    names = [c.split()[0] for c in PROVED.split(", ")]
    schema = pa.schema([(c, pa.int64() if c == "doc_id" else pa.string()) for c in names])

    def prove(block: pa.Table, above: pa.Table) -> pa.Table:
        path, subroot, root = (above[c][0].as_py() for c in ("path", "subroot", "root"))
        sides = [side.split("|") for side in path.split(";") if side]
        top = "walk.h"
        for _ in sides:
            top = f"sha256(? || {top} || ?)"
        sql = f"""
            {_walk(_levels_here(block, most), "coalesce(told, h)")}
            SELECT doc_id, nodes.h AS leaf, ? AS subroot, ? AS root, {"walk.path || ?" if whole else "CAST(NULL AS VARCHAR)"} AS path,
            sha256(replace(replace(walk.path || ?, '|', ''), ';', '')) AS proof_sha256, {top} AS folded_root FROM nodes JOIN walk ON walk.node = nodes.i"""
        # parameters stand in the text from the outermost level inwards on the left, and back on the right
        values = [subroot, root, *([path] if whole else []), path, *(left for left, _ in reversed(sides)), *(right for _, right in sides)]
        return run_sql(sql, block.select(["i", "h", "doc_id", "told"]), values).cast(schema)

    return prove


def blocks_of(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"i div {FAN**levels}"))


def rounds(nodes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """nodes (grp, i, n, h), then the blocks' roots of each round; in the last every group has one. ``most``: the largest group's nodes."""
    found = [blocks_of(nodes, levels)]
    while most > 1 or len(found) == 1:
        roots = found[-1].select("grp", "block", "i", "n", "h").groupBy("grp", "block").applyInArrow(block_roots(levels), "grp string, i long, n long, h string")
        found.append(blocks_of(written(roots, "roots"), levels))
        most = -(-most // FAN**levels)
    return found


def paths_below(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    blocks = nodes.select("grp", "block", "i", "n", "h").groupBy("grp", "block")
    return blocks.cogroup(paths.groupBy("grp", "i")).applyInArrow(block_paths(levels), "grp string, i long, path string")


def second_paths(tree: list[DataFrame], paths: DataFrame, levels: int) -> DataFrame:
    """Paths (grp, i, path) of the nodes of the second round, given those of the last."""
    return reduce(lambda found, nodes: paths_below(nodes, found, levels), reversed(tree[1:-1]), paths)


def manifest(docs: DataFrame, told: Column | None = None, whole: bool = True, levels: int = LEVELS) -> DataFrame:
    """PROVED for each document. ``told`` is the leaf to be checked against the root (null: the document's own). With ``whole`` the path is
    returned, else only the digest of its siblings, which saves some 3 KB a document."""
    with temporary(docs.sparkSession) as keep:
        grp = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))  # never null, in the same order
        told = F.lit(None).cast("string") if told is None else told
        leaves = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("h"), told.alias("told"))
        leaves = keep(written(ranked(leaves, "grp", ["doc_id", "h", "told"]), "leaves"))
        tree = rounds(leaves, leaves.agg(F.max("n")).first()[0] or 0, levels)
        subroots = tree[-1].select(F.lit("").alias("grp"), F.col("grp").alias("lang_key"), "h")
        top_nodes = written(ranked(subroots, "grp", ["lang_key"]), "subroots")
        top = rounds(top_nodes, top_nodes.agg(F.max("n")).first()[0] or 0, levels)
        root = top[-1].select("grp", F.lit(0).cast("long").alias("i"), F.lit("").alias("path"))
        of_langs = paths_below(top[0], second_paths(top, root, levels), levels)
        of_langs = top_nodes.join(of_langs, ["grp", "i"]).join(top[-1].select("grp", F.col("h").alias("root")), "grp")
        of_langs = written(of_langs.select(F.col("lang_key").alias("grp"), F.lit(0).cast("long").alias("i"), "path", F.col("h").alias("subroot"), "root"), "of_langs")
        above = second_paths(tree, of_langs.select("grp", "i", "path"), levels).join(of_langs.select("grp", "subroot", "root"), "grp")
        above = keep(written(above.select("grp", F.col("i").alias("block"), "path", "subroot", "root"), "above"))
    blocks = blocks_of(leaves, levels).select("grp", "block", "i", "n", "h", "doc_id", "told").groupBy("grp", "block")
    return blocks.cogroup(above.groupBy("grp", "block")).applyInArrow(block_proofs(levels, whole), PROVED)


def tampered_leaf() -> Column:
    """The leaf of the row with A-Z of its text in lower case."""
    text = F.col("text")
    ascii_only = F.length(text) == F.octet_length(text)
    return leaf_of(text=F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    proved = manifest(docs, F.when(fold("doc_id", 3) == 0, tampered_leaf()), whole=False)
    return proved.drop("path").withColumn("verified", F.col("folded_root") == F.col("root"))


def plain_sql(levels: int = 8, lang_levels: int = 4) -> str:
    """The manifest in SQL, for at most ``FAN ** levels`` documents a language and ``FAN ** lang_levels`` languages."""

    def tree(name: str, depth: int) -> str:
        """<name>_0 (g, i, n, h) level by level; <name>_w<k>: siblings to the left and right on each level."""
        out = []
        for k in range(depth):
            out.append(f"{name}_r{k} AS MATERIALIZED (SELECT g, i // {FAN} AS i, any_value(n) AS n, string_agg(h, '' ORDER BY i) AS run FROM {name}_{k} GROUP BY ALL)")
            out.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT g, i, (n + {FAN - 1}) // {FAN} AS n, CASE WHEN n > 1 THEN sha256(run) ELSE run END AS h FROM {name}_r{k})")
            at = f"CAST(w.i % {FAN} AS INTEGER)"
            out.append(
                f"{name}_w{k + 1} AS MATERIALIZED (SELECT key, g, i, CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f, proof || l || r AS proof FROM (SELECT w.key, w.g, w.i // {FAN} AS i, w.f, w.proof, r.n, "
                f"substr(run, 1, {HEX} * {at}) AS l, substr(run, {HEX} * {at} + {HEX + 1}) AS r FROM {name}_w{k} w JOIN {name}_r{k} r ON w.g = r.g AND w.i // {FAN} = r.i))"
            )
        return ",\n".join(out)

    def leaf(text: str) -> str:
        parts = (text if c == "text" else c for c in FIELDS)
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in parts) + ")"

    lower = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    # crc32, a byte and then a bit at a time; 3988292384 is its polynomial
    crc = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce(range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"
    return f"""
WITH leaves AS MATERIALIZED (SELECT row_number() OVER () AS key, doc_id, coalesce('=' || lang, '') AS g, {leaf("text")} AS h, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} END AS told FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
doc_0 AS (SELECT g, i, n, h FROM placed), doc_w0 AS (SELECT key, g, i, coalesce(told, h) AS f, '' AS proof FROM placed),
{tree("doc", levels)},
subroots AS MATERIALIZED (SELECT g AS lang_key, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM doc_{levels}),
lang_0 AS (SELECT '' AS g, i, n, h FROM subroots), lang_w0 AS (SELECT w.key, '' AS g, s.i, w.f, w.proof FROM doc_w{levels} w JOIN subroots s ON s.lang_key = w.g),
{tree("lang", lang_levels)}
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, top.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = top.h AS verified
FROM placed p JOIN lang_w{lang_levels} w USING (key) JOIN subroots s ON s.lang_key = p.g CROSS JOIN lang_{lang_levels} top
"""


SQL = {"op11_merkle_manifest": plain_sql()}
