"""Samples of labelled rows are bounded and never empty for one long text."""

from millrace.llm.common import labelled_sample


def test_bytes(docs, labels):
    texts = [(i, "x" * (1000 if i % 3 == 0 else 10)) for i in range(30)] + [(1, "other text")]
    df, marks = docs(texts), labels([(i, 0, i % 2) for i in range(30)] + [(1, 0, None), (None, 0, 1)])
    assert labelled_sample(df, marks, "toxic", 100).count() == 30
    some = labelled_sample(df, marks, "toxic", 100, most_bytes=105).collect()
    assert len(some) == 10 and all(len(r["text"]) == 10 for r in some)
    assert sum(len(r["text"]) for r in labelled_sample(df, marks, "toxic", 100, most_bytes=2000).collect()) <= 2000
    assert labelled_sample(df, marks, "toxic", 7).count() == 7
    assert labelled_sample(docs([]), marks, "toxic", 7, most_bytes=10).collect() == []
