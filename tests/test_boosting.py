"""Boosted trees against a plain version that tries every split of every node, one by one."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors

from millrace.operators import boosting as B


def plain_split(x, g, growth):
    best = (0.0, None)
    score = lambda s, n: s * s / (n + growth.ridge) if n + growth.ridge else 0.0
    for f in range(x.shape[1]):
        known = ~np.isnan(x[:, f])
        for missing_left in (False, True):
            for cut in sorted(set(x[known, f].tolist())):
                left = np.where(known, x[:, f] <= cut, missing_left)
                n, m = left.sum(), (~left).sum()
                if n < growth.least_rows or m < growth.least_rows or n == 0 or m == 0:
                    continue
                gain = 0.5 * (score(g[left].sum(), n) + score(g[~left].sum(), m) - score(g.sum(), len(g)))
                if gain > best[0] + 1e-7:
                    best = (gain, left)
    return best


def plain_predictions(x, y, growth):
    predicted = np.full(len(y), y.mean())
    for _ in range(growth.trees):
        g = predicted - y
        leaves = [(np.arange(len(y)), 0)]
        if growth.leaves:
            while len(leaves) < growth.leaves:
                gains = [plain_split(x[rows], g[rows], growth) for rows, _ in leaves]
                k = max(range(len(leaves)), key=lambda i: gains[i][0])
                if gains[k][1] is None:
                    break
                rows, left = leaves.pop(k)[0], gains[k][1]
                leaves += [(rows[left], 0), (rows[~left], 0)]
        else:
            done = []
            while leaves:
                rows, depth = leaves.pop()
                left = plain_split(x[rows], g[rows], growth)[1] if depth < growth.depth else None
                if left is None:
                    done.append((rows, depth))
                else:
                    leaves += [(rows[left], depth + 1), (rows[~left], depth + 1)]
            leaves = done
        for rows, _ in leaves:
            predicted[rows] -= growth.rate * g[rows].sum() / (len(rows) + growth.ridge)
    return predicted


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, 25, 400), rng.integers(0, 12, 400), rng.normal(size=400).round(1)], axis=1).astype(float)
    y = np.where(x[:, 0] > 12, 5.0, -3.0) + 0.7 * x[:, 1] + np.sin(x[:, 2]) + rng.normal(size=400) * 0.3
    x[rng.random(400) < 0.1, 1] = np.nan
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    return spark.createDataFrame([([None if math.isnan(v) else v for v in r], float(t)) for r, t in zip(x.tolist(), y, strict=True)], "x array<double>, y double").repartition(3)


GROWTHS = {
    "levels": B.Growth(trees=6, depth=4, rate=0.3),
    "leaves": B.Growth(trees=6, leaves=9, rate=0.3, ridge=0.0, least_rows=20),
}


@pytest.mark.parametrize("growth", GROWTHS.values(), ids=GROWTHS)
@pytest.mark.parametrize("one_task", [0, 1000], ids=["passes", "one task"])
def test_equals_plain(rows, data, growth, one_task):
    x, y = data
    base, cuts, trees = B.boost(rows, 3, growth, one_task)
    got = base + sum(t.predict(x, cuts) for t in trees)
    np.testing.assert_allclose(got, plain_predictions(x, y, growth), atol=1e-5)


def test_same_trees_either_way(rows):
    """Shares of rows and columns included; partitions and their order change no split."""
    growth = B.Growth(trees=25, depth=3, row_share=0.8, column_share=0.67, seed=3)
    spread, whole = B.boost(rows, 3, growth, 0), B.boost(rows, 3, growth)
    assert spread[2] == whole[2]
    full = B.Growth(trees=3, depth=3)
    assert B.boost(rows.repartition(1), 3, full)[2] == B.boost(rows.repartition(5), 3, full, 0)[2]
    values = [tree.feature for tree in whole[2]]
    assert len({f for t in values for f in t if f >= 0}) == 3 and all(len({f for f in t if f >= 0}) <= 2 for t in values)


def test_limits(rows, data):
    leafwise = B.boost(rows, 3, GROWTHS["leaves"])[2]
    assert all(t.feature.count(-1) <= 9 for t in leafwise) and any(t.feature.count(-1) == 9 for t in leafwise)
    with pytest.raises(ValueError, match="no rows"):
        B.boost(rows.limit(0), 3, B.Growth())
    same = rows.selectExpr("transform(x, v -> 1D) AS x", "y")
    base, _, trees = B.boost(same, 3, B.Growth(trees=2))
    assert base == pytest.approx(data[1].mean()) and all(t.feature == [-1] for t in trees)


def test_estimator(spark, data, tmp_path):
    """Vectors with missing values; a pipeline saves the trees and gives the same predictions again."""
    x, y = data
    df = spark.createDataFrame([(Vectors.dense(r), float(t), "kept") for r, t in zip(x.tolist(), y, strict=True)], ["features", "target", "prediction_note"])
    model = PipelineModel([B.HistogramBooster(labelCol="target", growth=B.Growth(trees=40)).fit(df)])
    found = [r["prediction"] for r in model.transform(df).collect()]
    assert ((np.array(found) - y) ** 2).mean() < 0.15 * y.var()
    model.write().overwrite().save(str(tmp_path / "model"))
    assert [r["prediction"] for r in PipelineModel.load(str(tmp_path / "model")).transform(df).collect()] == found
    assert model.transform(df.limit(0)).collect() == []


@pytest.mark.parametrize("share", [1.0, 0.8])
def test_few_groups_of_many_rows_take_one_task(spark, monkeypatch, share):
    """Passes are jobs only where bins differ in more rows than a task may hold, however many rows there are; the trees are the same."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (3000, 3)).astype(float)
    y = x[:, 0] * 2 + x[:, 1] - x[:, 2] + rng.normal(size=3000)
    rows = spark.createDataFrame([(r, float(t)) for r, t in zip(x.tolist(), y, strict=True)], "x array<double>, y double").repartition(3)
    growth = B.Growth(trees=8, depth=3, row_share=share)
    spread = B.boost(rows, 3, growth, 0)
    monkeypatch.delattr(B, "SpreadRows")
    found = B.boost(rows, 3, growth, 64)
    assert found[2] == spread[2]
    if share == 1:
        np.testing.assert_allclose(found[0] + sum(t.predict(x, found[1]) for t in found[2]), plain_predictions(x, y, growth), atol=1e-5)


def test_sums_are_whole():
    big = np.array([(1 << 56) + 1, -(1 << 56) - 3, (1 << 55) + 5, 7])
    assert B.whole_sums(np.array([0, 0, 1, 1]), big, 3).tolist() == [-2, (1 << 55) + 12, 0]


def test_candidates_share_bins(spark, data, monkeypatch):
    from millrace.operators import ml

    x, y = data
    df = spark.createDataFrame([(*r[:2], float(t)) for r, t in zip(x.tolist(), y, strict=True)], "a double, b double, y double")
    task = ml.Task("y", ("a", "b"))
    models = {k: B.HistogramBooster(labelCol="y", growth=g) for k, g in GROWTHS.items()}
    alone = {k: ml.fit_all(task, df, {k: m}).models[k].stages[-1].parts()[2] for k, m in models.items()}
    calls, plain = [], B.binned
    monkeypatch.setattr(B, "binned", lambda *a: calls.append(1) or plain(*a))
    both = ml.fit_all(task, df, models).models
    assert len(calls) == 1 and {k: m.stages[-1].parts()[2] for k, m in both.items()} == alone
