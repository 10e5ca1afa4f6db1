"""Places of the base phrases against a loop; licences of the method."""

import math
import random
import re

import pytest

from millrace.llm import licenses as L


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in L.BASE_PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


TEXTS = ["MIT license mit-license MIT  License", "the GNU Lesser General Public License", "Apache, License Version 2.0", "mit licenses", "é漢字MIT license", "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "all right, reserved", "Licensed under CC BY-NC 4.0.", "general public", None, "", "mit mit license license"]


def test_places(docs, odd, none):
    df = docs(list(enumerate(TEXTS))).unionByName(odd)
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], [(p["start"], p["label"]) for p in r["base_places"]]) for r in L.scan_licenses(df).collect()), key=str)
    assert got == sorted(((d is None, d or 0, *plain(t)) for d, t in texts), key=str)
    assert L.scan_licenses(none).count() == 0


def test_method_labels(docs):
    found = {r["doc_id"]: {f["label"]: f["share"] for f in r["found"]} for r in L.scan_licenses(docs(list(enumerate(TEXTS)))).collect()}
    assert found[5] == {"apache-2.0": 1.0} and set(found[6]) == {"proprietary"} and found[7] == {} and set(found[8]) == {"cc-by-nc-4.0"} and "lgpl" in found[1]


def test_same_as_looking_everywhere(docs):
    """Places and shares against a look at each start; few different words, so that phrases overlap and words repeat."""
    rng = random.Random(5)
    notices = (("x", "a b a c a b d", "a c a"), ("y", "b b", "b b"), ("z", "d a b c d a", "a b c"), ("x", "c c a a", "a a"))
    phrases = (("a b", "one"), ("b b a", "two"), ("d", "three"))
    texts = [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["", None]
    got = {r["doc_id"]: r for r in L.scan_licenses(docs(list(enumerate(texts))), notices, phrases, least=0.0).collect()}
    files = [(t or "").split() for t in texts]
    idf = lambda w: math.log((len(files) + 1) / (sum(w in f for f in files) + 1)) + 1
    for i, f in enumerate(files):
        places = sorted((s, label) for p, label in phrases for s in range(len(f)) if f[s : s + len(p.split())] == p.split())
        shares = {}
        for label, notice, key in notices:
            n, k = notice.split(), key.split()
            off = next(o for o in range(len(n)) if n[o : o + len(k)] == k)
            for s in range(len(f)):
                if f[s : s + len(k)] == k:
                    same = sum(idf(w) for j, w in enumerate(n) if 0 <= s - off + j < len(f) and f[s - off + j] == w)
                    shares[label] = max(shares.get(label, 0), same / sum(map(idf, n)))
        assert sorted((x["start"], x["label"]) for x in got[i]["base_places"]) == places
        assert {x["label"]: x["share"] for x in got[i]["found"]} == pytest.approx(shares)


def test_query_of_whole_notices(spark, docs, tmp_path):
    filler = " and more words here. "
    pairs = [(i, filler * 3 + " ".join(w.upper() if j % 3 else w + "," for j, w in enumerate(n.split())) + filler) for i, (_, n, _) in enumerate(L.NOTICES)]
    pairs += [(100, None), (101, ""), (None, "MIT license"), (102, "the mit-license, MIT  LICENSE"), (102, "the mit-license, MIT  LICENSE"), (103, "public license general " * 30000)]
    docs(pairs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = L.op9_license_scan(spark, str(tmp_path)).collect()
    assert rows[0].asDict().keys() == {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"}
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(pairs) and all(label in got[i]["labels"].split(",") and got[i]["score"] == pytest.approx(1.0) for i, (label, _, _) in enumerate(L.NOTICES))
    value = lambda i: tuple(got[i])[1:]
    assert value(100) == value(101) == (0, 0, None, None, "", "", 0.0)
    assert value(102)[:5] == (5, 2, 1, 3, "mit") and value(None)[:5] == (2, 1, 0, 0, "mit") and value(103)[:5] == (90000, 29999, 2, 89996, "gpl")
