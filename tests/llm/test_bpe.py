"""Ids against the tokenizers library; round trips."""

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe
from millrace.llm.tokens import encode

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ALPHABET = "ab Z's\n\t é漢\U0001f600.,0-<|endoftext|>"


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=300))
def test_ids_are_the_library_s(text):
    assert encode(text).tolist() == ids_of(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=ALPHABET, min_size=1, max_size=400), st.lists(st.integers(0, 400), max_size=6))
def test_any_chunks_are_repaired(text, cuts):
    raw = text.encode()
    bounds = sorted({0, len(raw), *(bpe._edge(raw, min(c, len(raw))) for c in cuts)})
    shared = {(a, b): encode(raw[a:b].decode()) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if k % 3 != 1}
    assert bpe.assemble(raw, shared).tolist() == ids_of(text)


def test_chunks_follow_the_content():
    rng = np.random.default_rng(1)
    body = "".join(rng.choice(list("abcdefgh éß"), 20000))
    raw = body.encode()
    bounds = bpe.chunk_bounds(raw)
    assert bounds[0] == 0 and bounds[-1] == len(raw) and bounds == sorted(set(bounds))
    assert all((raw[a:b]).decode() for a, b in zip(bounds, bounds[1:], strict=False))
    shifted = ("zzz" + body).encode()
    own = {raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)}
    other = bpe.chunk_bounds(shifted)
    assert len(own & {shifted[a:b] for a, b in zip(other, other[1:], strict=False)}) > 0.8 * len(own)
    assert bpe.chunk_bounds(b"") == [0]
    assert max(np.diff(bpe.chunk_bounds(b"x" * 50000))) <= bpe.MOST


def test_documents_round_trip(odd, docs, none):
    passage = "Sentences that several documents share, word for word, are encoded once. " * 40
    some = odd.unionByName(docs([(20 + i, f"Head {i} here. {passage} Tail {i}.") for i in range(6)]))
    texts = {(r["doc_id"], r["text"]) for r in some.collect()}
    got = bpe.encode_documents(some)
    assert got.count() == some.count()
    by_id = {i: t or "" for i, t in texts}
    assert all(r["ids"] == ids_of(by_id[r["doc_id"]]) for r in got.collect())
    assert {(r["doc_id"], r["text"]) for r in bpe.decode_documents(got).collect()} == {(i, t or "") for i, t in texts}
    assert bpe.encode_documents(none).count() == 0 and bpe.digest_documents(none).count() == 0
