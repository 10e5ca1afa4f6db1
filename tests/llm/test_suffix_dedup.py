"""Repeated strings against a count of all strings."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import suffix_dedup as S
from millrace.llm import superblocks


def brute(pairs, length):
    raws = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(r)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def query(docs, length, **how):
    from pyspark.sql import functions as F

    _, spans = S.repeat_spans(docs, length, **how)
    ids = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tk"))
    rows = ids.join(spans, "tk").collect()
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize(("seed", "length", "group_rows"), [(1, 24, 256), (2, 24, 2), (3, 40, 3)])
def test_same_as_brute_force(docs, seed, length, group_rows):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = [word(rng.randint(length // 2, 4 * length)) for _ in range(6)]
    pairs = [(i, "".join(word(rng.randint(0, 60)) + rng.choice(shared) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    pairs += [(100, "ab" * 200), (101, "a" * 300), (102, None), (103, ""), (104, pairs[3][1]), (104, pairs[3][1]), (None, shared[0] * 2)]
    assert query(docs(pairs), length, group_rows=group_rows) == brute(pairs, length)


def test_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert query(odd, 400) == brute([(i, t) for i, t in rows], 400)
    assert query(none, 400) == []


def test_collection_finds_what_stands_twice():
    rng = np.random.default_rng(4)
    blocks = [rng.integers(97, 99, rng.integers(12, 20)).astype(np.uint8) for _ in range(40)]
    back, counts = rng.integers(0, 5, 40), np.array([len(b) - 6 + 1 for b in blocks])
    flags = S.collection_repeats(blocks, back, counts, 6)
    at = Counter((s - back[i], b[s : s + 6].tobytes()) for i, b in enumerate(blocks) for s in range(counts[i]))
    for i, b in enumerate(blocks):
        for s in range(counts[i]):
            assert flags[i, s] == (at[s - back[i], b[s : s + 6].tobytes()] > 1)
    # of three texts, the third counts as several
    who = rng.integers(0, 3, 40)
    flags = S.collection_repeats(blocks, back, counts, 6, who)
    owners = {}
    for i, b in enumerate(blocks):
        for s in range(counts[i]):
            owners.setdefault((s - back[i], b[s : s + 6].tobytes()), []).append(who[i])
    for i, b in enumerate(blocks):
        for s in range(counts[i]):
            own = owners[s - back[i], b[s : s + 6].tobytes()]
            assert flags[i, s] == (len(own) > 1 and (0 in own or len(set(own)) > 1))


def brute_passages(pairs, n):
    """Words of each row that stand in n-word windows which another text or copy holds too."""
    texts = [re.findall(r"[^ \t\n\x0b\x0c\r]+", t or "") for _, t in pairs]
    raw = [t or "" for _, t in pairs]
    found = {}
    for i, w in enumerate(texts):
        for k in range(len(w) - n + 1):
            found.setdefault(tuple(w[k : k + n]), set()).add(raw[i])
    out = []
    for i, w in enumerate(texts):
        hit = set()
        for k in range(len(w) - n + 1):
            if len(found[tuple(w[k : k + n])]) > 1 or raw.count(raw[i]) > 1:
                hit.update(range(k, k + n))
        out.append(hit)
    return texts, out


@pytest.mark.parametrize(("seed", "n", "group_rows"), [(1, 5, 128), (2, 5, 2), (3, 9, 3)])
def test_passages_same_as_brute_force(docs, seed, n, group_rows):
    rng = random.Random(seed)
    words = lambda k: [rng.choice(("a", "b", "ö", "cd")) for _ in range(k)]
    blank = lambda: rng.choice((" ", "  ", "\n", "\t \x0b"))
    shared = [words(rng.randint(n - 1, 3 * n)) for _ in range(5)]
    texts = ["".join(w + blank() for _ in range(rng.randint(0, 4)) for w in words(rng.randint(0, 9)) + rng.choice(shared)) for _ in range(50)]
    pairs = list(enumerate(texts)) + [(60, None), (61, ""), (62, " ".join(["x", "y", "z"] * n)), (63, texts[3]), (63, texts[3]), (64, "  " + " ".join(shared[0] * 2))]
    split, hits = brute_passages(pairs, n)
    out = S.remove_repeats(docs([(k, t) for k, (_, t) in enumerate(pairs)]), S.word_passages(n), group_rows).collect()
    left = {r["doc_id"]: r["text"] for r in out}
    for k, (_, t) in enumerate(pairs):
        want = None if t is None else [w for i, w in enumerate(split[k]) if i not in hits[k]]
        assert (None if left[k] is None else left[k].split()) == want


def test_query_counts_passages(spark, docs, tmp_path):
    rng = random.Random(8)
    words = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(k))
    passage, line = words(55), words(30)
    pairs = [(1, words(30) + " " + passage + "\n" + words(9)), (2, passage.replace(" ", "\n")), (3, words(200)), (4, line + " " + words(20) + line), (5, None), (6, " ".join([line] * 9)), (None, words(3))]
    docs(pairs).write.parquet(str(tmp_path / "documents.parquet"))
    tables = lambda: {t.name for t in spark.catalog.listTables("millrace_scratch")}
    before = tables() if spark.catalog.databaseExists("millrace_scratch") else set()
    out = {r["doc_id"]: r for r in S.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert {i: (r["n_passages"], r["n_passage_bytes"]) for i, r in out.items()} == {1: (1, len(passage)), 2: (1, len(passage)), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0), None: (0, 0)}
    assert sorted((i, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in out.items() if i) == [r for r in brute(pairs, 400) if r[0]]
    assert [t.split("_")[0] for t in tables() - before] == ["spans"]


@pytest.mark.parametrize(("split", "length", "gram"), [(superblocks.as_bytes, 30, 10), (superblocks.as_words, 6, 2)])
def test_joined_texts_have_their_own_runs(split, length, gram):
    rng = random.Random(9)
    raws = ["".join(rng.choice("abé \n") for _ in range(rng.choice([0, 5, 40, 400]))).encode() for _ in range(60)]
    apart, together = [], []
    for i, raw in enumerate(raws):
        apart += [(i, *map(int, r)) for r in zip(*superblocks.runs(split(raw).values, length, gram), strict=True)]
    for first, group in superblocks.text_groups(raws, 1000):
        values, bounds = superblocks.joined(group, split)
        for t, key, start, n, place in zip(*superblocks.joined_runs(values, bounds, length, gram), strict=True):
            together.append((first + int(t), int(key), int(start - bounds[t]), int(n), int(place - bounds[t])))
    assert together == apart and [r for _, g in superblocks.text_groups(raws, 1000) for r in g] == raws


def test_runs_cover_all_starts_and_agree():
    rng = np.random.default_rng(5)
    a = rng.integers(97, 101, 3000).astype(np.uint8)
    key, start, n, place = superblocks.runs(a, 50, 16)
    assert n.sum() == len(a) - 49 and (start[1:] == start[:-1] + n[:-1]).all()
    moved = superblocks.runs(a[700:], 50, 16)
    own = {(k, p - 700 - s) for k, s0, c, p in zip(key, start, n, place, strict=True) for s in range(s0 - 700, s0 - 700 + c) if s >= 0}
    assert own == {(k, p - s) for k, s0, c, p in zip(*moved, strict=True) for s in range(s0, s0 + c)}


def test_stretches_meet(monkeypatch):
    a = np.random.default_rng(6).integers(97, 123, 5000).astype(np.uint8)
    whole = superblocks.runs(a, 60, 20)
    monkeypatch.setattr(superblocks, "STRETCH", 1000)
    superblocks._powers.cache_clear()
    parts = superblocks.runs(a, 60, 20)
    superblocks._powers.cache_clear()
    spread = lambda r: [(k, p) for k, s, c, p in zip(*r, strict=True) for _ in range(c)]
    assert spread(whole) == spread(parts)


def test_rows_keep_their_columns(docs):
    passage = "".join(chr(97 + i * i % 26) for i in range(300)) * 2
    out = S.remove_repeats(docs([(1, "é" + passage + "x"), (2, "y" + passage), (3, "short"), (4, None)])).orderBy("doc_id")
    assert out.columns == docs([]).columns
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()] == [(1, "éx", 2), (2, "y", 1), (3, "short", 5), (4, None, None)]


def test_a_string_of_very_many_texts(docs, monkeypatch):
    """One string in ever more differing texts, dealt to collections that are merged in rounds: all its places are found, and the largest
    group of a round doesn't grow with the texts."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    shared = word(60)
    pairs = [(i, word(rng.randint(20, 60)) + shared + word(rng.randint(20, 60))) for i in range(2000)]
    groups, real = [], S.merge_round

    def counted(packed, *how):
        sizes = packed.selectExpr("unit", "key", "part", "range", f"length(entries) / {S._ENTRY.itemsize} AS n").groupBy("unit", "key", "part", "range").agg({"n": "sum"})
        groups.append(sizes.agg({"sum(n)": "max"}).first()[0])
        return real(packed, *how)

    monkeypatch.setattr(S, "merge_round", counted)
    largest = []
    for few in (500, 2000):
        groups.clear()
        assert query(docs(pairs[:few]), 40, group_rows=8, fan=4) == brute(pairs[:few], 40)
        assert len(groups) >= 2
        largest.append(max(groups))
    assert largest[1] <= 1.5 * largest[0]


@pytest.mark.parametrize(("seed", "fan"), [(21, 2), (22, 5)])
def test_rounds_of_words_same_as_brute_force(docs, seed, fan):
    rng = random.Random(seed)
    words = lambda k: [rng.choice(("a", "b", "ö", "cd")) for _ in range(k)]
    shared = [words(rng.randint(5, 15)) for _ in range(4)]
    pairs = [(k, " ".join(w for _ in range(rng.randint(0, 5)) for w in words(rng.randint(0, 9)) + rng.choice(shared))) for k in range(80)]
    split, hits = brute_passages(pairs, 5)
    left = {r["doc_id"]: r["text"] for r in S.remove_repeats(docs(pairs), S.word_passages(5), 2, fan).collect()}
    for k, _ in pairs:
        assert left[k].split() == [w for i, w in enumerate(split[k]) if i not in hits[k]]
