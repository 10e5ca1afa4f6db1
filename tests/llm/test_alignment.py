"""Alignments against tokens, groups and links taken one by one."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, pre_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import alignment as A

FIRST = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FIRST.encode_special_tokens = True
SECOND = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The byte that each character of a byte-level token stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


BYTES = byte_of()
assert set(BYTES) == set(pre_tokenizers.ByteLevel.alphabet())


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def tokens_of(text):
    if not text:
        return [], []
    a = [(i, bytes(BYTES[c] for c in FIRST.id_to_token(i))) for i in FIRST.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in SECOND.encode(text):
        piece = SECOND.id_to_piece(i)
        b.append((i, bytes([int(piece[3:-1], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()))
    if any(b"".join(d for _, d in x) != (" " + text).encode() for x in (a, b)):
        return [], []
    return spans(a), spans(b)


def plain(texts):
    rows, counts = [], Counter()
    for i, text in texts:
        a, b = tokens_of(text)
        links = []
        for x, s, e in a:
            links += [(x, y) for y, s2, e2 in b if s < e2 and s2 < e] if len(a) < 400 else []
        if len(a) >= 400:  # the same by two pointers
            p = q = 0
            while p < len(a) and q < len(b):
                links.append((a[p][0], b[q][0]))
                p, q = p + (a[p][2] <= b[q][2]), q + (b[q][2] <= a[p][2])
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, low = [], 0
        for cut in cuts if len(cuts) < 2000 else ():
            groups.append("|".join(",".join(str(t) for t, s, e in x if low <= s and e <= cut) for x in (a, b)))
            low = cut
        rows.append((i, len(a), len(b), len(cuts), links, ";".join(groups) if len(cuts) < 2000 else None))
        counts.update(links)
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    return [(i, n, m, k, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), g) for i, n, m, k, links, g in rows]


TEXTS = [
    (1, "Plain words, twice. Plain words, twice."),
    (2, "a  b\n\n c\t\r\n  tail  "),
    (3, "漢字 ÄÖÜ ñandú 😀 é́   x"),
    (4, "<|endoftext|> </s> <unk> <0x41> <s>"),
    (5, "blank ▁ as a letter"),
    (6, "Plain words, twice."),
    (7, None),
    (8, ""),
    (9, " "),
    (10, "x" * 3000),
    (11, "\x00\x01 control \x7f"),
    (None, "no id"),
    (6, "Plain words, twice."),
    (12, "".join(f"{k} some words in a longer text, " for k in range(400))),
]


def same(df, texts, digest):
    key = lambda r: tuple((x is None, x or 0) for x in r[:7])
    got, want = sorted((tuple(r) for r in df.collect()), key=key), sorted(plain(texts), key=key)
    assert [r[:7] for r in got] == [r[:7] for r in want]
    for r, w in zip(got, want, strict=True):
        if w[7] is not None:
            assert r[7] == (hashlib.sha256(w[7].encode()).hexdigest() if digest and w[7] else w[7])


@pytest.mark.parametrize("block_bytes", [1, 500, 1 << 24])
def test_against_plain(docs, block_bytes):
    same(A.weighed_alignment(docs(TEXTS).repartition(3), block_bytes=block_bytes), TEXTS, False)


def test_odd_rows(odd, none, docs):
    clash = odd.selectExpr("*", "1 AS block", "2 AS pairs", "3 AS n_a", "4 AS groups")
    same(A.weighed_alignment(clash), [(r["doc_id"], r["text"]) for r in odd.collect()], False)
    assert A.weighed_alignment(none).collect() == []
    same(A.weighed_alignment(docs([(1, None), (2, "")])), [(1, None), (2, "")], False)


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = A.op13_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(out, [(r["doc_id"], r["text"]) for r in docs.collect()], True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=60), st.data())
def test_bits(sizes, data):
    """Groups and links of two random cuts of the same bytes."""
    total = sum(sizes)
    ends = sorted({*data.draw(st.lists(st.integers(1, total), max_size=60)), total})
    others = np.diff(ends, prepend=0)
    found = A.Aligned(np.arange(len(sizes)), np.arange(len(others)), np.array(sizes), others)
    a, b = spans((i, b"x" * n) for i, n in enumerate(sizes)), spans((i, b"x" * n) for i, n in enumerate(others))
    assert sorted(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e]
    cuts = sorted({e for *_, e in a} & {e for *_, e in b})
    assert found.a_stops.tolist() == [sum(e <= c for *_, e in a) for c in cuts] and found.b_stops.tolist() == [sum(e <= c for *_, e in b) for c in cuts]
