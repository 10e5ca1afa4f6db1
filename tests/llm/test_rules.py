"""Statistics against loops; learned lists."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import rules as R


def plain(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs, odd, none):
    rng = random.Random(5)
    pairs = [(i + 100, "".join(rng.choice(["a", "b", "é ", " ", "\n", "# ", "c\x0b", "\x1c", " ", "漢 "]) for _ in range(rng.randint(0, 120)))) for i in range(200)]
    df = docs(pairs).unionByName(odd)
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted(tuple(r)[:6] for r in R.document_statistics(df.where("doc_id is not null")).collect())
    assert got == sorted((d, *plain(t)) for d, t in texts if d is not None)
    assert R.document_statistics(none).count() == 0


def test_many_words_stay_exact():
    ids = np.arange(20000)
    ids[15000:15006] = ids[:6]
    assert R.repeated_window_words(ids, 20000) == 12


def test_learned_list_separates():
    rng = np.random.default_rng(6)
    x = {"a": rng.random(2000), "b": rng.random(2000), "c": rng.random(2000)}
    bad = (x["a"] > 0.9) | ((x["b"] < 0.2) & (x["c"] > 0.7))
    learned = R.learn_rules(x, bad)
    hit = np.zeros(2000, bool)
    for rule in learned:
        hit |= R._covered(rule, x, 2000)
    assert (hit & bad).sum() > 0.95 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()
    assert R.learn_rules(x, np.zeros(2000, bool)) == []


def test_verdicts(docs, odd, none, labels):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    good = [(i, " ".join(word() for _ in range(60))) for i in range(0, 120, 2)]
    junk = [(i, " | ".join(word() + "***" for _ in range(60))) for i in range(1, 120, 2)]
    df = docs(good + junk)
    out = R.judge_documents(df, labels([(i, int(i % 2 == 0), 0) for i in range(0, 90)] + [(None, 1, 0), (3, None, None)]))
    assert {r["doc_id"] for r in out.where("kept").collect()} == {i for i, _ in good}
    assert R.judge_documents(odd, labels([])).where("kept").count() == 0  # all short or of one word
    assert R.judge_documents(none, labels([])).count() == 0


def test_expression_is_ordered(spark):
    df = spark.createDataFrame([(5.0,), (1.0,)], "v double").select(*(F.lit(1).alias(c) for c in R.COUNTS))
    first, second = [R.Condition("words", True, 1.0)], [R.Condition("words", True, 0.0)]
    assert df.select(R.decision_list([first, second]).alias("r")).first()["r"] == 1
