import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Columns of documents, and some whose names operators might use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, tk string, fp string, key string, kept string, spans string, n long"


def rows_of(texts):
    return [(i, t, None, None, None if t is None else len(t), 0.5, "x", "y", "z", None, "s", 1) for i, t in texts]


@pytest.fixture(scope="session")
def docs(spark):
    """A maker of documents from (doc_id, text) pairs."""
    return lambda pairs: spark.createDataFrame(rows_of(pairs), SCHEMA)


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, blanks, repeated rows, a long text, one without spaces, one of many scripts."""
    return docs([(1, None), (2, ""), (3, " \n\t "), (4, "a b"), (5, "word " * 30000), (6, "x" * 50000), (7, "ä漢字 \U0001f600é b c  <|endoftext|> d"), (7, "ä漢字 \U0001f600é b c  <|endoftext|> d"), (None, "no id"), (8, "tail")])


@pytest.fixture(scope="session")
def none(docs):
    return docs([])


@pytest.fixture(scope="session")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))
