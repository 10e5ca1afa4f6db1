"""Every token is in one place; bins keep every capacity."""

import zlib

import numpy as np
import public_tokenizers
from conftest import as_rows
from tokenizers import Tokenizer

from millrace.llm import packing as P

PLAIN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_and_places(odd, none):
    rows = [r.asDict() for r in P.pack_documents(odd, 64).collect()]
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = []
    for d, t in texts:
        ids = np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        count = -(-len(ids) // 64)
        first = len(ids) - 64 * (count - 1)
        edges = [0, *range(first, len(ids) + 1, 64)]
        want += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        places.sort()
        assert [a for a, _ in places] == list(np.cumsum([0] + [n for _, n in places])[:-1]) and sum(n for _, n in places) <= 64
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 64) + 1
    assert as_rows(P.pack_documents(none)) == []


def test_all_capacities_hold():
    rng = np.random.default_rng(2)
    lengths = np.sort(rng.integers(1, 100, 500))[::-1]
    for by in ("norm", "dot"):
        bins, offsets = P.vector_best_fit(lengths, 100, 5, 6000.0, by=by)
        for b in np.unique(bins):
            own = lengths[bins == b]
            assert own.sum() <= 100 and len(own) <= 5 and (own.astype(float) ** 2).sum() <= 6000.0 + 1e-6 or len(own) == 1
            assert sorted(offsets[bins == b]) == list(np.cumsum([0, *own[np.argsort(offsets[bins == b])]])[:-1])


def test_few_bins_are_wasted():
    lengths = np.sort(np.random.default_rng(3).integers(1, 1500, 4000))[::-1]
    bins, _ = P.vector_best_fit(lengths, 2048, 2048, 2048.0**2)
    assert len(np.unique(bins)) <= 1.02 * -(-lengths.sum() // 2048)
