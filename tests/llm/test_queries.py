"""The registered queries on whole small tables: their columns against plain versions, odd rows, empty tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from brute_pii import base_spans, digest
from test_bpe import PLAIN, ids_of
from test_licenses import plain as plain_licence
from test_rules import plain as plain_statistics
from test_simhash import plain as plain_fingerprint

from millrace.llm import registry

SF = "/root/testdata/sf0.001"
QUERIES = {k.split("_")[0]: f for k, f in registry.queries().items()}
COLUMNS = {
    "op1": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op2": "doc_id held_out score predicted",
    "op3": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4": "doc_id fingerprint component_id",
    "op5": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6": "doc_id held_out score predicted",
    "op7": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8": "doc_id piece start length ids_crc32 sequence_id offset",
    "op9": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op10": "query_id rank vec_id score",
    "op11": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12": "doc_id n_lines n_dropped kept_sha256",
    "op13": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}
TYPES = {"held_out": "boolean", "score": "double", "predicted": "int", "piece": "int", "rank": "int", "base_failed": "boolean", "kept": "boolean", "verified": "boolean"}
TEXTS = {"kept_sha256", "ids_sha256", "decoded_sha256", "fingerprint", "base_sha256", "spans", "base_labels", "labels", "leaf", "subroot", "root", "proof_sha256", "folded_root", "groups_sha256"}


@pytest.fixture(scope="module")
def tables(spark, odd, tmp_path_factory):
    """The rows of the smallest tables, with odd ones, ids that repeat and columns whose names operators use themselves."""
    folder = tmp_path_factory.mktemp("tables")
    real = spark.read.parquet(f"{SF}/documents.parquet")
    real.unionByName(odd.select("*").withColumn("doc_id", odd["doc_id"] + 100_000), allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").union(spark.createDataFrame([(None, 1, 1), (100_005, 1, 0), (100_007, 0, 1), (100_007, 1, None)], "doc_id long, quality int, toxic int")).write.parquet(f"{folder}/labels.parquet")
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    strange = [(500_000, None), (500_100, [0.0] * 64), (500_200, [math.nan] * 64), (500_300, [1.0, 2.0]), (500_301, [1.0, 3.0]), (500_302, [None, 3.0]), (None, [1.0] * 64)]
    vectors.union(spark.createDataFrame([(i, v, 0) for i, v in strange], vectors.schema)).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def texts(spark, tables):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]


def run(spark, tables, op):
    df = QUERIES[op](spark, tables)
    kinds = dict(df.dtypes)
    for c in COLUMNS[op].split():
        assert kinds[c] == ("string" if c in TEXTS else TYPES.get(c, "bigint")), c
    return [tuple(r) for r in df.select(*COLUMNS[op].split()).collect()]


def same(rows, want):
    key = lambda r: tuple((x is None, str(type(x)), x) for x in r)
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, want), key=key)


def test_every_query_is_there():
    assert sorted(QUERIES) == sorted(COLUMNS)


def test_op1(spark, tables, texts):
    from test_suffix_dedup import brute

    same(run(spark, tables, "op1"), brute(texts, 400))


def test_op3(spark, tables, texts):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in texts:
        ids = ids_of(t)
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(PLAIN.decode(ids, skip_special_tokens=False).encode())))
    same(run(spark, tables, "op3"), want)


def test_op4(spark, tables, texts):
    fps = [plain_fingerprint(t) for _, t in texts]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(texts[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    same(run(spark, tables, "op4"), [(texts[i][0], f"{fp:016x}", least[find(i)]) for i, fp in enumerate(fps)])


def test_op5(spark, tables, texts):
    rows = run(spark, tables, "op5")
    want = []
    for i, t in texts:
        spans = base_spans(t)
        want.append((i, *(sum(k == kind for k, *_ in spans) for kind in ("email", "ip", "card", "phone")), digest(spans)))
    same([r[:6] for r in rows], want)
    of = {i: {f"{k}:{a}:{b}" for k, a, b in base_spans(t)} for i, t in texts if i is not None}
    assert all(of[r[0]] <= set(r[6].split(",")) for r in rows if r[0] is not None)


@pytest.mark.parametrize(("op", "label", "modulus", "away", "cut"), [("op2", "toxic", 3, 1, 0.7), ("op6", "quality", 5, 0, 0.3)])
def test_scores(spark, tables, texts, tmp_path, op, label, modulus, away, cut):
    rows = run(spark, tables, op)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % modulus == away
    assert len(rows) == len(texts) and all(0 <= s <= 1 and p == int(s >= cut) and h == held(i) for i, h, s, p in rows)
    # labels of held-out rows, and columns beside the text, change no score
    docs, labels = spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet").collect()
    docs.selectExpr("doc_id", "text", "'xx' AS lang", "'y' AS source", "7L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    flip = lambda r, c: r[c] if r[c] is None or c != label or not held(r["doc_id"]) else 1 - r[c]
    spark.createDataFrame([(r["doc_id"], flip(r, "quality"), flip(r, "toxic")) for r in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    same(run(spark, str(tmp_path), op), rows)


def test_op7(spark, tables, texts):
    rows = run(spark, tables, "op7")
    want = []
    for i, t in texts:
        n, chars, symbols, lines, repeated = plain_statistics(t)
        want.append((i, n, chars, symbols, lines, repeated, n < 10 or 100 * repeated > 20 * n))
    same([r[:7] for r in rows], want)
    assert not any(r[6] and r[7] for r in rows)


def test_op8(spark, tables, texts):
    rows = run(spark, tables, "op8")
    want, tokens = [], 0
    for i, t in texts:
        ids = np.array([*ids_of(t), 0], "<u4")
        tokens += len(ids)
        first = (len(ids) - 1) % 2048 + 1
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    same([r[:5] for r in rows], want)
    bins = {}
    for *_, length, _, sequence, offset in rows:
        bins.setdefault(sequence, []).append((offset, length))
    for places in bins.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(bins) <= -(-tokens // 2048) + 1


def test_op9(spark, tables, texts):
    want = []
    for i, t in texts:
        n, places = plain_licence(t)
        starts = [s for s, _ in places]
        want.append((i, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    rows = run(spark, tables, "op9")
    same([r[:6] for r in rows], want)
    assert all(set(filter(None, r[5].split(","))) <= set(r[6].split(",")) and r[6] == ",".join(sorted(set(r[6].split(",")))) and 0 <= r[7] <= 1 for r in rows)


def test_op10(spark, tables):
    rows = run(spark, tables, "op10")
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect() if r["vec_id"] is not None and r["embedding"] is not None and None not in r["embedding"]}
    vectors = {i: v for i, v in vectors.items() if np.isfinite(v).all() and v.any()}
    got, hits, n = {}, 0, 0
    for q, rank, i, score in sorted(rows):
        got.setdefault(q, []).append(i)
        assert rank == len(got[q]) and i != q and score == pytest.approx(math.sqrt(((vectors[q] - vectors[i]) ** 2).sum()), rel=1e-12)
    assert got.keys() == {i for i in vectors if i % 100 == 0}
    for q, found in got.items():
        near = sorted((float(((vectors[q] - v) ** 2).sum()), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:10]
        hits, n = hits + len({i for _, i in near} & set(found)), n + len(near)
        assert len(found) == len(near)
    assert hits >= 0.9 * n and got[500_300] == [500_301]


def test_op11(spark, tables):
    from test_merkle import plain

    same(run(spark, tables, "op11"), plain(spark.read.parquet(f"{tables}/documents.parquet").collect()))


def test_op12(spark, tables, texts):
    from test_line_dedup import plain

    same(run(spark, tables, "op12"), [(i, n, d, hashlib.sha256(kept.encode()).hexdigest()) for i, n, d, kept in plain(texts)])


def test_op13(spark, tables, texts):
    from test_alignment import plain

    want = {tuple(r[:7]) for r in plain(texts)}
    rows = run(spark, tables, "op13")
    assert len(rows) == len(texts) and {r[:7] for r in rows} == want and all((r[7] == "") == (r[1] == 0) for r in rows)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for op in COLUMNS:
        assert run(spark, str(tmp_path), op) == []
