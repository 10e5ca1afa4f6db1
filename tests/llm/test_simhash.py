"""Fingerprints and components against plain loops."""

import re

import numpy as np
import xxhash
from conftest import as_rows

from millrace.llm import simhash as S
from millrace.llm.components import connected


def plain(text, n=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    hashes = [xxhash.xxh64(" ".join(words[i : i + n]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - n + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(odd):
    texts = [r["text"] for r in odd.collect()] + ["A b C", "One two three four", "one Two three four five\x0bsix\x1cseven"]
    assert [S.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def brute_groups(fps, most):
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= most:
                    root[i] = root[j] = min(root[i], root[j])
    return root


def test_links_and_components(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 12)
    fps = [int(base[k % 12]) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 7))) for k in range(150)]
    prints = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
    for rows in (1024, 7):
        edges = S.link_edges(prints.select("fp").distinct(), 4, part_rows=rows)
        roots = {r["node"]: r["root"] for r in connected(edges).collect()}
        want, same = brute_groups(fps, 4), {}
        for f, w in zip(fps, want, strict=True):
            same.setdefault(w, set()).add(roots.get(f, f))
        assert all(len(x) == 1 for x in same.values()) and len({next(iter(x)) for x in same.values()}) == len(same)


def test_masks_find_every_link():
    rng = np.random.default_rng(8)
    for depth in (1, 2, 3):
        masks = S.masks(4, depth)
        for _ in range(200):
            off = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(off & (m & (2**64 - 1)) == 0 for m in masks)


def test_gray_rank():
    n = np.arange(64, dtype=np.uint64)
    assert (S.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in connected(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_odd_rows(odd, none):
    found = S.near_duplicates(odd)
    got = {(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in found.collect()}
    assert found.count() == odd.count()
    assert {(1, 0, 1), (2, 0, 1), (3, 0, 1)} <= got
    assert as_rows(S.near_duplicates(none)) == []


def test_one_of_each_group_stays(odd, none, docs):
    kept = S.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted([(False, i) for i in (1, 4, 5, 6, 7, 8)] + [(True, 0)])
    assert S.keep_one(none).count() == 0
    long = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions in the old tower near the river " * 3
    near = docs([(5, long), (3, long), (9, long.upper()), (4, "something else entirely, with other words in it")])
    assert sorted(r["doc_id"] for r in S.keep_one(near).collect()) == [3, 4]
