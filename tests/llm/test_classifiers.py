"""Held-out accuracy, and rows that hold nothing."""

import random

import numpy as np

from millrace.llm import quality, toxicity
from millrace.llm.common import fold


def _texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "do", "ki", "lu", "mer", "tan"]) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 200))]
        if i % 4 == 0:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(["wretched", "hateful", "vermin"]))
        if i % 5 == 0:
            words = [w.upper() + "!!" for w in words]
        out.append((i, " ".join(words)))
    return out


def test_accuracy(docs, labels):
    df = docs(_texts(1200, 1))
    y = labels([(i, int(i % 5 != 0), int(i % 4 == 0)) for i in range(1200)])
    scored = quality.score_documents(df.select("doc_id", "text"), quality.fit_quality(df, y, fold("doc_id", 5) != 0)).where(fold("doc_id", 5) == 0).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 5 != 0) for r in scored]) > 0.95
    model = toxicity.fit_toxicity(df, y, fold("doc_id", 3) != 1)
    scored = toxicity.score_documents(df, model).where(fold("doc_id", 3) == 1).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in scored]) > 0.9
    assert [r["doc_id"] for r in quality.keep_good(df, y).select("doc_id").collect()].count(4) == 1
    assert quality.keep_good(df, y).columns == df.columns


def test_odd_rows(odd, none, docs, labels):
    y = labels([(i, i % 2, i % 2) for i in range(300)] + [(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0)])
    train = docs(_texts(300, 2))
    for fit, score in ((quality.fit_quality, quality.score_documents), (toxicity.fit_toxicity, toxicity.score_documents)):
        model = fit(train, y)
        for df in (odd, none):
            rows = score(df.select("doc_id", "text"), model).collect()
            assert len(rows) == df.count() and all(0 <= r["score"] <= 1 for r in rows)
        blank = fit(none, labels([]))
        assert {r["score"] for r in score(odd.select("doc_id", "text"), blank).collect()} <= ({1.0} if fit is quality.fit_quality else {1 / (1 + np.exp(50.0))})
    assert quality.keep_good(odd, labels([])).count() == odd.count()


def test_windows_hold_all_bytes():
    raw = ("some words and averyveryverylongwordwithoutanyblankinside " * 9).encode()
    assert b"".join(toxicity.windows(raw, 48)) == raw and max(map(len, toxicity.windows(raw, 48))) <= 48
    assert toxicity.windows(b"", 48) == [b""]


def test_descent_separates():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(50, 8, replace=False)) + (50 if k % 2 else 0) for k in range(200)]
    y = np.arange(200) % 2
    ratios = quality.log_count_ratios(rows, y)
    w, c = quality.dual_coordinate_descent(rows, ratios, y, np.ones(200))
    margins = [c + (w[x] * ratios[x]).sum() / np.sqrt(len(x)) for x in rows]
    assert all((m > 0) == bool(t) for m, t in zip(margins, y, strict=True))
