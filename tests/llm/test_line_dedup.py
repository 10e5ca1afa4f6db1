"""Lines stay in the first document that holds them, whatever the batches and levels."""

import hashlib
import string

import pytest
from conftest import SCHEMA, as_rows

from millrace.llm import line_dedup as L

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(texts, least=10):
    """(doc_id, n_lines, n_dropped, kept) of each row."""
    key_of = lambda line: line.strip(BLANKS).translate(LOWER)
    rank = lambda i: (i is None, i or 0)
    owner = {}
    for i, t in texts:
        for line in (t or "").split("\n"):
            owner[key_of(line)] = min(owner.get(key_of(line), rank(i)), rank(i))
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key_of(x)) < least or owner[key_of(x)] == rank(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def same(df, texts):
    got = [(r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(plain(texts), key=key)


LONG = "A line that many documents hold"
TEXTS = [
    (5, f"{LONG}\nown line of five\n{LONG}"),
    (3, f"  {LONG.upper()}\r\nshort\n\nÄÖÜ GROSS UND KLEIN"),
    (9, f"{LONG}\t\nshort\nown line of nine\n"),
    (9, f"another row of nine\n{LONG}"),
    (9, f"another row of nine\n{LONG}"),
    (12, "äöü gross und klein\nÄÖÜ gross und klein"),
    (None, f"own line of five\nonly here, without an id\n{LONG}"),
    (14, None),
    (15, ""),
    (16, "only here, without an id"),
    (17, "\n".join(f"numbered line {k % 700}" for k in range(20000)) + "\n" + LONG),
    (18, "numbered line 699"),
    (19, "x" * 300000 + "\n" + "x" * 300000),
    (20, "x" * 300000),
    (21, "123456789\n1234567890"),
    (22, "123456789\n1234567890\n 漢字漢字漢字漢字漢字 "),
    (23, "漢字漢字漢字漢字漢字"),
]


@pytest.mark.parametrize(("batches", "fan"), [(1, 2), (4, 2), (9, 2), (5, 3)])
def test_against_plain(docs, batches, fan):
    same(L.drop_repeated_lines(docs(TEXTS), batches=batches, fan=fan), TEXTS)


def test_odd_rows_and_columns(docs, odd, none, spark):
    same(L.drop_repeated_lines(odd), [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert L.drop_repeated_lines(none).collect() == [] and L.without_repeated_lines(none).columns == none.columns
    clash = docs(TEXTS).selectExpr("*", "'a' AS pos", "1 AS digest", "2 AS gone", "3 AS batch", "4 AS n_dropped", "5 AS row", "6 AS lines")
    out = L.without_repeated_lines(clash)
    assert out.columns == clash.columns
    texts = {i: (t if n == 0 else kept) for (i, t), (_, _, n, kept) in zip(TEXTS, plain(TEXTS), strict=True)}
    assert {(r["doc_id"], r["text"]) for r in out.collect()} >= set(texts.items())
    assert as_rows(out.drop("text")) == as_rows(clash.drop("text"))


def test_batches_one_by_one(spark, docs):
    """Documents may come in any order of ids over time: lines stay in the batch that brought them first."""
    batches = [[(7, f"{LONG}\nseven has this")], [(1, f"{LONG}\none has this line")], [(8, "seven has this\none has this line\nand this is new")], [(2, "And This Is New ")]]
    with L.LineRuns(spark, fan=2) as runs:
        out = [as_rows(runs.add(L.line_hashes(docs(b))).select("doc_id", "pos")) for b in batches]
        assert [len(level) for level in runs.levels] == [0, 0, 1] and runs.levels[2][0][1].count() == 4
    assert out == [[], [(1, 0)], [(8, 0), (8, 1)], [(2, 0)]]


def test_plan_merges_runs_without_shuffles(spark, docs):
    """A bucketed, sorted run meets a batch's keys without an exchange or a sort."""
    with L.LineRuns(spark, fan=9) as runs, L.sorted_buckets(spark):
        for k in range(2):
            runs.add(L.line_hashes(docs([(k, f"a line of batch {k}\nand one of both")])))
        (_, first), (_, second) = runs.levels[0]
        plan = second.join(first.hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan


def test_native(spark, docs):
    plan = L.without_repeated_lines(docs(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_schema(spark):
    out = L.op12_line_dedup(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("doc_id", "bigint"), ("n_lines", "bigint"), ("n_dropped", "bigint"), ("kept_sha256", "string")] and "text" in SCHEMA
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = sorted((i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in plain(texts))
    assert sorted(map(tuple, out.collect())) == want
