"""Recall and exact scores against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, label int, cell long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def brute(rows, q, k=10):
    own = dict(rows)[q]
    d = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(map(float, np.float32(v)), map(float, np.float32(own)), strict=True))), i) for i, v in rows if i != q]
    return [i for _, i in sorted(d)[:k]]


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 4
    rows = [(i, [float(np.float32(x)) for x in centres[i % 20] + rng.normal(size=16)]) for i in range(3000)]
    df = frame(spark, rows)
    got = {}
    for r in N.nearest(df, df.where("vec_id % 100 = 0"), sample_rows=1000).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    hits = [len(set(x.values()) & set(brute(rows, q))) for q, x in got.items()]
    assert len(got) == 30 and sum(hits) >= 0.9 * 300


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (100, [0.0, 1.0])]
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in N.nearest(df, df.where("vec_id % 100 = 0")).collect())
    root = math.sqrt(2.0)
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, root), (0, 4, 100, root), (100, 1, 3, 0.0), (100, 2, 0, root), (100, 3, 1, root), (100, 4, 2, root)]
    assert N.nearest(df.where("vec_id = 5"), df.where("vec_id = 5")).count() == 0
    assert N.nearest(frame(spark, []), frame(spark, [])).count() == 0


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(5000)] + [(9000 + i, [3.0, float(i)]) for i in range(50)]
    df = frame(spark, rows)
    got = N.nearest(df, df.where(F.col("vec_id") == 100)).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(10)) and {r["score"] for r in got} == {0.0}


def test_walks_are_shorter_than_the_index(spark):
    """At three sizes, without structure and with it: recall of 0.9, and a share of the different vectors that falls with their number."""
    rng = np.random.default_rng(3)
    walked = []
    for n in (1500, 6000, 24000):
        x = np.float32(rng.normal(size=(n, 16)))
        df = frame(spark, [(i, v) for i, v in enumerate(x.tolist())]).repartition(8)
        rows = df.select(F.col("embedding").cast("array<double>").alias("v"))
        walked.append(N.fit(rows, n, 20_000, 0.95)[1])
        got = {}
        for r in N.nearest(df, df.where("vec_id % 100 = 0")).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        hits = 0
        for q, found in got.items():
            d = ((x - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            hits += len(found & set(np.argsort(d, kind="stable")[:10].tolist()))
        assert len(got) == n // 100 and hits >= 0.9 * 10 * len(got)
    assert walked[0] < 0.6 and walked[0] > walked[1] > walked[2]
    near = np.repeat(rng.normal(size=(60, 16)) * 6, 100, axis=0) + rng.normal(size=(6000, 16))
    assert N.fit(spark.createDataFrame([(v,) for v in near.tolist()], "v array<double>"), 6000, 20_000, 0.95)[1] < 0.05


def test_each_dimension_for_itself(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=(5, 2, 1)[i % 3]).tolist()) for i in range(900)]
    df = frame(spark, rows)
    got = {}
    for r in N.nearest(df, df.where("vec_id % 100 = 0"), exact_rows=200 + 90).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = {q: len(set(x) & set(brute([r for r in rows if r[0] % 3 == q % 3], q))) for q, x in got.items()}
    assert len(got) == 9 and all(len(x) == 10 and {v % 3 for v in x} == {q % 3} for q, x in got.items()) and sum(hits.values()) >= 81


def test_walk_rises():
    rng = np.random.default_rng(2)
    index = N.MultiIndex(rng.normal(size=(300, 8)), 6)
    index.counts = {c: 1 for c in range(36)}
    q = rng.normal(size=8)
    cells, reach = index.walk(q, 36)
    sums = [float(((q[:4] - index.books[0][c // 6]) ** 2).sum() + ((q[4:] - index.books[1][c % 6]) ** 2).sum()) for c in cells]
    assert abs(reach - sums[-1]) < 1e-9 and sorted(cells) == list(range(36)) and all(a <= b + 1e-9 for a, b in zip(sums, sums[1:], strict=False))


def test_repeated_rows_beside_equal_vectors(spark):
    rows = [(5, [1.0, 2.0])] * 40 + [(i, [1.0, 2.0]) for i in (6, 7, 8, 100)] + [(5, [1.0, 2.0 + j / 1000]) for j in range(1, 30)] + [(20 + i, [2.0, float(i)]) for i in range(8)]
    df = frame(spark, rows).coalesce(1)
    got = N.nearest(df, df.where("vec_id = 100")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [5, 6, 7, 8, 22, 21, 23, 20, 24, 25] and [r["score"] for r in got[:4]] == [0.0] * 4
