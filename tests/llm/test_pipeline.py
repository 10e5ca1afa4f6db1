"""The stages one after the other on small documents."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as C
from millrace.llm.common import written


def test_stages(spark, docs, odd, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, copied = text(90), text(120)
    pairs = [(i, text(80)) for i in range(100)] + [(200 + i, " ".join(w.upper() + "!!" for w in text(80).split())) for i in range(40)]
    pairs += [(300, copied), (301, copied), (302, text(40) + " " + passage + " " + text(40)), (303, text(50) + " " + passage), (304, text(60) + " write to me@example.com")]
    df = docs(pairs)
    spark.createDataFrame([(i, int(not 200 <= i < 240), 0) for i, _ in pairs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in C.STAGES] == ["quality", "near_copies", "repeats", "personal_data", "packing"]
    seen = {}
    for name, stage in C.STAGES:
        df = written(stage(spark, df, str(tmp_path)), name)
        seen[name] = {r["doc_id"]: r for r in df.collect()}
        if name != "packing":
            assert df.columns == docs([]).columns
    assert not any(200 <= i < 240 for i in seen["quality"]) and set(range(100)) <= set(seen["quality"])
    assert 300 in seen["near_copies"] and 301 not in seen["near_copies"] and set(range(100)) <= set(seen["near_copies"])
    assert passage not in seen["repeats"][302]["text"] and passage not in seen["repeats"][303]["text"] and seen["repeats"][5]["text"] == dict(pairs)[5]
    assert seen["personal_data"][304]["text"].endswith("[EMAIL]")
    assert set(seen["packing"]) == set(seen["personal_data"])


def test_odd_rows(spark, odd, none, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for df in (odd, none):
        for name, stage in C.STAGES:
            df = written(stage(spark, df, str(tmp_path)), name)
        assert df.count() >= 0


def test_columns_of_any_name(spark, docs, tmp_path):
    """Columns that have the names of the stages' own ones come back as they were."""
    words = " ".join(f"word{k}" for k in range(70))
    pairs = [(1, f"one {words} mail a@b.example"), (2, f"two {words}"), (3, "Plain text without anything."), (4, None), (5, "Plain text without anything.")]
    names = "spans_email kept_text found_ip gaps_ip _spans _text spans body row redacted _cut_key _cut_tk _cut_text _cut_none key cut none tk _tk _id _kept id away_id away_tk root times first score".split()
    df = docs(pairs)
    df = df.select("*", *(F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names if n not in df.columns))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    before = {r["doc_id"]: r.asDict() for r in df.collect()}
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        for r in out.collect():
            own = r.asDict()
            assert {k: v for k, v in own.items() if k not in ("text", "n_chars")} == {k: v for k, v in before[r["doc_id"]].items() if k not in ("text", "n_chars")}
    C.STAGES[-1][1](spark, df, str(tmp_path)).collect()


def test_whole_table_against_plain_versions(spark):
    from brute_pii import base_spans
    from test_bpe import ids_of
    from test_simhash import plain
    from test_suffix_dedup import brute_passages

    sf = "/root/testdata/sf0.001"
    df, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in C.STAGES:
        before = df
        df = written(stage(spark, df, sf), name)
        out[name] = (before.collect(), df.collect())
    before, after = out["quality"]
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) > len(before) / 2

    before, after = out["near_copies"]
    fps = [plain(r["text"]) for r in before]
    root = list(range(len(fps)))
    for _ in fps:
        old = list(root)
        for i, a in enumerate(fps):
            for j in range(i):
                if (a ^ fps[j]).bit_count() <= 4:
                    root[i] = root[j] = min(root[i], root[j])
        if root == old:
            break
    least = {}
    for i, r in enumerate(before):
        least[root[i]] = min(least.get(root[i], r["doc_id"]), r["doc_id"])
    assert sorted(tuple(r) for r in after) == sorted(tuple(r) for r in before if r["doc_id"] in set(least.values()))

    before, after = out["repeats"]
    words, gone = brute_passages([(r["doc_id"], r["text"]) for r in before], 50)
    left = {r["doc_id"]: r for r in after}
    assert len(after) == len(before) and any(gone)
    for r, w, g in zip(before, words, gone, strict=True):
        new = left[r["doc_id"]]
        assert new["text"] == r["text"] if not g else new["text"].split() == [x for i, x in enumerate(w) if i not in g]
        assert new["n_chars"] == len(new["text"])

    before, after = out["personal_data"]
    left = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        spans = base_spans(r["text"])
        assert (left[r["doc_id"]] != r["text"]) >= bool(spans)
        assert all(f"[{k.upper()}]" in left[r["doc_id"]] for k in {k for k, a, b in spans if not any(x != k and c < b and a < d for x, c, d in spans)})

    before, after = out["packing"]
    tokens = {r["doc_id"]: len(ids_of(r["text"])) + 1 for r in before}
    held = {}
    for r in after:
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["length"]
    assert held == tokens
