"""What the toxic dictionary learns."""

import random

from millrace.llm import toxicity as T


def test_short_words_phrases_and_small_groups_mark(docs, labels):
    rng = random.Random(4)
    marks, pairs = ["scum", "go to it", "salaud"], []
    kind = [-1] * 1200 + [0] * 280 + [1] * 280 + [2] * 24  # the last group is 4 % of the toxic texts
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(3, 9))) for _ in range(300)]
    for i, k in enumerate(kind):
        words = rng.choices(vocabulary, k=60)
        for at in (10, 30, 50) if k >= 0 else ():
            words[at] = marks[k]
        pairs.append((i, " ".join(words)))
    model = T.fit_toxicity(docs(pairs), labels([(i, 1, int(k >= 0)) for i, k in enumerate(kind)]))
    assert all(f" {w} ".encode() in model.toxic for w in marks)
    scores = [model.score(t) >= T.CUT for _, t in pairs]
    caught = [sum(s for s, k in zip(scores, kind, strict=True) if k == g) / kind.count(g) for g in range(3)]
    assert caught[0] >= 0.4 and min(caught[1:]) >= 0.9  # six bytes alone in a window save little
    assert sum(s for s, k in zip(scores, kind, strict=True) if k < 0) <= 0.02 * 1200


def test_thresholds_are_calibrated(docs, labels):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstu", k=6)) for _ in range(300)]
    text = lambda toxic: " ".join([*rng.choices(vocabulary, k=40), *["worthless"] * toxic])
    pairs = [(i, text(i % 3 == 0)) for i in range(600)]
    model = T.fit_toxicity(docs(pairs), labels([(i, 1, int(i % 3 == 0)) for i in range(600)]))
    assert (model.marked, model.strong) in T.THRESHOLDS
    assert sum((model.score(t) >= T.CUT) == (i % 3 == 0) for i, t in pairs) >= 590
