"""The tree, its proofs and what tampering does to them, against a plain version."""

import hashlib
import string
import zlib

import pytest
from conftest import as_rows
from pyspark.sql import functions as F

from millrace.llm import merkle as M

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(value, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))))


def climb(nodes):
    """The root, and for each node its (left, right) siblings level by level."""
    paths, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[a : a + 8] for a in range(0, len(nodes), 8)]
        for k, at in enumerate(of):
            run, own = runs[at // 8], at % 8
            paths[k].append(("".join(run[:own]), "".join(run[own + 1 :])))
            of[k] = at // 8
        nodes = [sha("".join(run)) for run in runs]
    return nodes[0], paths


def plain(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        found = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r["text"] or "", k) for k, r in enumerate(langs[lang])))
        ordered = [langs[lang][k] for *_, k in found]
        trees[lang] = (ordered, *climb([leaf(r, r["text"]) for r in ordered]))
    root, tops = climb([trees[x][1] for x in order]) if order else ("", [])
    out = []
    for lang, top in zip(order, tops, strict=True):
        ordered, subroot, paths = trees[lang]
        for r, path in zip(ordered, paths, strict=True):
            node = leaf(r, r["text"])
            if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 3 == 0 and r["text"] is not None:
                node = leaf(r, r["text"].translate(LOWER))
            for left, right in path + top:
                node = sha(left + node + right)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, sha("".join(a + b for a, b in path + top)), node, node == root))
    return out


def same(df, rows):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = [tuple(r[c] for c in NAMES) for r in df.collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def query(spark, docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return M.op11_merkle_manifest(spark, str(folder))


def test_small_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    out = M.op11_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert out.columns == list(NAMES) and dict(out.dtypes)["verified"] == "boolean"
    same(out, rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_several_rounds(spark, levels):
    """Blocks of 8 and 64 leaves: languages of 1, 8, 9, 64, 65 and 700 documents, and 80 languages of one."""
    sizes = {None: 65, "a": 1, "b": 8, "c": 9, "d": 64, "e": 700} | {f"é{k}": 1 for k in range(80)}
    rows = [(k * 7 % 1009, f"Text {k} of {lang}", lang, None if k % 5 else "src", k) for lang, n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    proved = M.manifest(docs, F.when(M.fold("doc_id", 3) == 0, M.tampered_leaf()), levels=levels)
    same(proved.withColumn("verified", F.col("folded_root") == F.col("root")), docs.collect())


def test_odd_rows(spark, odd, none, tmp_path):
    docs = odd.withColumn("lang", F.when(F.col("doc_id") > 3, F.lit("")).otherwise(F.col("lang"))).selectExpr("*", "1 AS grp", "2 AS i", "3 AS h", "4 AS block", "5 AS told")
    same(query(spark, docs, tmp_path / "odd"), docs.collect())
    assert query(spark, none, tmp_path / "none").collect() == []


def test_paths_prove(spark, odd):
    """Whole paths, folded by Spark's functions, give the root; any other leaf doesn't."""
    out = M.manifest(odd)
    assert out.where(M.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert out.where(M.folded(F.sha2(F.lit("other"), 256), F.col("path")) == F.col("root")).count() == 0
    digest = F.sha2(F.regexp_replace("path", "[|;]", ""), 256)
    assert out.where((digest != F.col("proof_sha256")) | (F.col("folded_root") != F.col("root"))).count() == 0


def test_order_of_rows_and_partitions(spark, odd):
    want = as_rows(M.manifest(odd))
    assert as_rows(M.manifest(odd.repartition(7, "text"))) == want
