"""The scores of the two classifiers against plain versions, over whole tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard

from millrace.llm import quality, registry, toxicity
from millrace.llm.common import fold, table

SF = "/root/testdata/sf0.01"
QUERIES = {k.split("_")[0]: f for k, f in registry.queries().items()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def marks(spark, target):
    return {r["doc_id"]: r[target] for r in table(spark, SF, "labels").collect() if r["doc_id"] is not None and r[target] is not None}


def crc(i, end=""):
    return zlib.crc32(f"{i}{end}".encode())


def plain_indicators(text):
    """A set of hashed byte n-grams; each different n-gram is hashed by itself."""
    raw, out, top = (text or "").encode(), set(), 1 << 32
    for k in quality.ORDERS:
        for gram in {raw[i : i + k] for i in range(len(raw) - k + 1)}:
            h = 0
            for byte in gram:
                h = (h * 257 + byte) % top
            h = h * quality._MULTIPLIERS[k] % top
            out.add(((h ^ h >> 15) * 0x85EBCA6B % top) >> 15)
    out -= set(range(16))
    words = raw.split()
    if len(words) > 5:
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        out |= set(range(math.ceil((len(runs) - len(set(runs))) / len(runs) * 16)))
    return out


def kernel_descent(x, y, costs, rounds=12, seed=3):
    """The machine's coefficients by the matrix of inner products (constant included); no weights are kept."""
    inner, sign = x @ x.T + 1, np.where(y == 1, 1.0, -1.0)
    alpha, rng = np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            slack = sign[i] * float(inner[i] @ (alpha * sign)) - 1
            new = float(np.clip(alpha[i] - slack / inner[i, i], 0, costs[i]))
            moved, alpha[i] = max(moved, abs(new - alpha[i])), new
        if moved < 1e-3:
            break
    return alpha * sign


def test_quality_scores(spark, texts):
    labels, found = marks(spark, "quality"), {i: plain_indicators(t) for i, t in texts.items()}
    rows = sorted((i for i in labels if i in texts and crc(i) % 5), key=lambda i: (crc(i, "half"), i))
    own, other = [i for i in rows if crc(i, "half") % 5], [i for i in rows if not crc(i, "half") % 5]
    seen = {kind: Counter(x for i in own if labels[i] == kind for x in found[i]) for kind in (0, 1)}
    total = {kind: sum(seen[kind].values()) + 2**quality.BITS for kind in (0, 1)}
    ratio = lambda x: math.log((seen[1][x] + 1) / total[1] / ((seen[0][x] + 1) / total[0]))
    at = {x: k for k, x in enumerate(sorted(set().union(*found.values())))}

    def scaled(ids):
        out = np.zeros((len(ids), len(at)))
        for r, i in enumerate(ids):
            for x in found[i]:
                out[r, at[x]] = ratio(x) / math.sqrt(len(found[i]))
        return out

    x, y = scaled(own), np.array([labels[i] for i in own])
    beta = kernel_descent(x, y, (len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2))))[y])
    margins = lambda ids: scaled(ids) @ (beta @ x) + beta.sum()
    z, good = margins(other), np.array([labels[i] for i in other], float)
    a = b = 0.0
    for _ in range(200):  # the curve, by its own small steps of Newton's
        p = 1 / (1 + np.exp(-(a + b * z)))
        v, ga, gb = p * (1 - p), (p - good).sum() + 0.01 * a, ((p - good) * z).sum() + 0.01 * b
        haa, hab, hbb = v.sum() + 0.01, (v * z).sum(), (v * z * z).sum() + 0.01
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    ids = list(texts)
    want = dict(zip(ids, 1 / (1 + np.exp(-np.clip(a + b * margins(ids), -50, 50))), strict=True))
    got = {r["doc_id"]: r for r in QUERIES["op6"](spark, SF).collect()}
    assert got.keys() == want.keys() and len({labels[i] for i in own}) == 2
    assert all(abs(r["score"] - want[i]) < 1e-3 and r["held_out"] == (crc(i) % 5 == 0) for i, r in got.items())
    assert all(r["predicted"] == int(want[i] >= 0.3) for i, r in got.items() if abs(want[i] - 0.3) > 1e-3)


def plain_windows(text, size):
    raw = b" " + b" ".join(re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())) + b" "
    while raw:
        end = raw.rfind(b" ", size // 2, size) if len(raw) > size else len(raw)
        end = size if end < 0 else end
        yield raw[:end] + b" "
        raw = raw[end:]


def test_toxicity_scores(spark, texts):
    docs = table(spark, SF, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, SF, "labels"), fold("doc_id", 3) != 1)
    assert model.weights and model.toxic and model.ordinary
    p = zstandard.ZstdCompressionParameters(compression_level=3, min_match=toxicity.MATCH, strategy=zstandard.STRATEGY_BTLAZY2, window_log=15, hash_log=14, chain_log=15, search_log=7, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(window))

    def plain(text):
        saved = [length(w, model.ordinary) - length(w, model.toxic + model.ordinary) for w in plain_windows(text, model.size)]
        n, marked, strong = len(saved), sum(s >= model.marked for s in saved), sum(s >= model.strong for s in saved)
        parts = [1, marked / n, strong / n, sum(saved) / n, max(saved) / 10, math.log1p(marked), math.log1p(strong), math.log1p(n), math.sqrt(marked / n), math.sqrt(strong / n)]
        return 1 / (1 + math.exp(-max(-50, min(50, sum(w * x for w, x in zip(model.weights, parts, strict=True))))))

    got = {r["doc_id"]: r for r in QUERIES["op2"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        want = plain(texts[i])
        assert abs(r["score"] - want) < 1e-9 and r["held_out"] == (crc(i) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7)


def plain_grams(raw):
    """(place, gram) of GRAM bytes without a blank inside a word, and of whole words, blanks included, of 3 to GRAM bytes."""
    n, out = toxicity.GRAM, []
    for i in range(len(raw)):
        for size in range(3, n + 1):
            gram = raw[i : i + size]
            if len(gram) == size and (gram[:1] == gram[-1:] == b" " or (size == n and b" " not in gram[1:-1])):
                out.append((i, gram))
    return out


def test_evidence_and_stretches(spark, texts):
    labels = marks(spark, "toxic")
    both = {kind: sorted({toxicity.words_only(texts[i]) for i in labels if labels[i] == kind and i in texts})[:40] for kind in (0, 1)}
    grams, evidence = toxicity.gram_evidence(both[1], both[0])
    number = lambda g: int.from_bytes(g, "big")
    held = {kind: Counter(g for t in both[kind] for g in {g for _, g in plain_grams(t)}) for kind in (0, 1)}
    share, want = len(both[1]) / (len(both[0]) + len(both[1])), {}
    for g, here in held[1].items():
        if here >= toxicity.LEAST:
            there = held[0][g]
            n = here + there
            ratio = here * math.log(here / (n * share)) + (there * math.log(there / (n * (1 - share))) if there else 0)
            want[number(g)] = 2 * ratio if here > n * share else 0.0
    assert grams.tolist() == sorted(want) and np.allclose(evidence, [want[g] for g in sorted(want)])
    chosen = grams[evidence >= np.quantile(evidence, 0.9)]
    for raw in both[1]:
        runs = []
        for i, g in plain_grams(raw):
            if number(g) in set(chosen.tolist()):
                if runs and i < runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], i + len(g))
                else:
                    runs.append([i, i + len(g)])
        assert toxicity.marked_stretches(raw, chosen) == [raw[a:b] for a, b in runs]
