"""Spans against Python's regular expressions."""

import random

from brute_pii import base_spans, digest
from conftest import as_rows
from pyspark.sql import functions as F

from millrace.llm import pii

PARTS = ["a@b.co", "a.b+c@x-y.example.com", "@", "x@y", "a@b.c@d.e", "a@b.c_x@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (212) 555-0100", "+49", "+123456789012345678", "++44 20 7946 0958.", "é", "\U0001f600", "\n", " ", "-", ".", "12", "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789"]


def found(docs):
    out = pii.find_pii(docs, ("doc_id",))
    return out.select("doc_id", pii._joined(pii.BASE_KINDS).alias("base"), F.sha2(pii._joined(pii.BASE_KINDS), 256).alias("sha"), pii._joined(pii.KINDS).alias("all"))


def test_same_as_the_plain_rule(docs):
    rng = random.Random(3)
    pairs = [(i, "".join(rng.choice(PARTS) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 12)))) for i in range(600)]
    texts = dict(pairs)
    for r in found(docs(pairs)).collect():
        assert r["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(texts[r["doc_id"]])), texts[r["doc_id"]]
        assert r["sha"] == digest(base_spans(texts[r["doc_id"]]))


def test_long_and_odd_texts(docs, odd, none):
    pairs = [(1, "1" * 60000), (2, "a" * 60000), (3, "a@" + "b." * 30000 + "c"), (4, "1 " * 30000), (5, "+1" + " (" * 30000), (6, "1." * 20000)]
    texts = dict(pairs)
    assert all(r["base"] == ",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(texts[r["doc_id"]])) for r in found(docs(pairs)).collect())
    assert {r["all"] for r in found(odd).collect()} == {""} and found(none).count() == 0


def test_method_adds_spans(docs):
    rows = {r["doc_id"]: r["all"] for r in found(docs([(1, "my iban is GB82 WEST 1234 5698 7654 32."), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn 123-45-6789"), (4, "part 123-45-6789")])).collect()}
    assert rows == {1: "iban:11:38", 2: "", 3: "ssn:4:15", 4: ""}


def test_context_raises_scores(docs):
    score = {r["doc_id"]: r["s"] for r in pii.find_pii(docs([(1, "call +1 212 555 0100"), (2, "code +1 212 555 0100")]), ("doc_id",)).select("doc_id", F.col("spans_phone")[0]["score"].alias("s")).collect()}
    assert score[1] > score[2]


def test_redaction_keeps_columns(odd, docs):
    out = pii.redact_pii(docs([(1, "\U0001f600 write a@b.co or +1 212 555 0100!"), (2, None), (3, "clean")]))
    assert out.columns == docs([]).columns
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in out.orderBy("doc_id").collect()] == [(1, "\U0001f600 write [EMAIL] or [PHONE]!", 27), (2, None, None), (3, "clean", 5)]
    assert as_rows(pii.redact_pii(odd)) == as_rows(odd)


def test_ibans_end_where_they_do(docs):
    texts = ["IBAN DE89370400440532013000 BIC COBADEFFXXX", "GB82WEST12345698765432 We pay", "DE89 3704 0044 0532 0130 00 EUR 500", "\U0001f600 NO93 8601 1117 947 I think", "NO12 3456789 GB82 WEST 1234 5698 7654 32", "DE89370400440532013000x DE89370400440532013000 GB82WEST12345698765432"]
    rows = {r["doc_id"]: r["all"] for r in found(docs(list(enumerate(texts)))).collect()}
    assert rows == {0: "iban:5:27", 1: "iban:0:22", 2: "iban:0:27", 3: "iban:2:20", 4: "iban:13:40", 5: "iban:24:46,iban:47:69"}


def test_context_of_the_whole_text(docs):
    rows = {r["doc_id"]: r["all"] for r in found(docs([(1, "ssn 123-45-6789, 123-45-6780"), (2, "ssn 000-45-6789 or 123-45-6780"), (3, "ssn 123-45-6789" + " " * 40 + "123-45-6780")])).collect()}
    assert rows == {1: "ssn:4:15,ssn:17:28", 2: "ssn:19:30", 3: "ssn:4:15"}
