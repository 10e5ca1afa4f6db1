"""Invariants of operators on small inputs."""

import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions import vectors as V
from millrace.operators import features, grid, inspect, joins, relational, sampling, standardize
from millrace.plans import guards
from millrace.sources import files, sinks


def literal_chunks(text, size=1000, overlap=150, least=50):
    text, out, start = text.strip(), [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            found = [(text.rfind(s, start + size // 2, end), s) for s in X.SEPARATORS]
            end = next((at + len(s) for at, s in found if at >= 0), end)
        piece = text[start:end].strip()
        if len(piece) >= least:
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + size - overlap)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab. \né", max_size=4000), min_size=1, max_size=6))
def test_chunks_are_those_of_a_loop(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {}
    for r in sorted(X.chunks(df, "text").collect(), key=lambda r: (r["id"], r["pos"])):
        got.setdefault(r["id"], []).append(r["chunk"])
    assert got == {i: c for i, t in enumerate(texts) if (c := literal_chunks(t))}


def test_chunks_without_gaps(spark):
    text = "x" * 520 + ". " + "y" * 900 + " " + " ".join(map(str, range(1000, 1400)))
    rows = X.chunks(spark.createDataFrame([(text,)], "text string"), "text", gap_free=True).orderBy("pos").collect()
    at = 0
    for r in rows:
        place = text.index(r["chunk"])
        assert not text[at:place].strip()
        at = max(at, place + len(r["chunk"]))
    assert at == len(text)


def test_clean(spark):
    raw = "ﬁne wa-\nter\x07  and\t\tmore \r\n\r\n\r\n\r\nend  "
    assert X.clean(spark.createDataFrame([(raw,), (None,)], "t string"), "t").orderBy("t").collect()[1]["t"] == "fine water and more\n\nend"


def test_left_join_never_grows(spark):
    base = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    facts = spark.createDataFrame([("a", 1)], "k string, v int")
    out = joins.enrich(base, facts, ["k"])
    assert out.count() == 3 and joins.match_report(out).first()["matched_rows"] == 1


def test_cap_refuses(spark):
    assert len(relational.capped(spark.range(200))) == 200
    with pytest.raises(relational.TooManyRows):
        relational.capped(spark.range(201))


def test_types_are_inferred_over_all_rows(spark):
    df = spark.createDataFrame([("1", "1.5", "x", ""), ("-2", ".5e3", "1", None)], "a string, b string, c string, d string")
    assert {r[0]: r[1] for r in inspect.infer_types(df).collect()} == {"a": "INTEGER", "b": "REAL", "c": "TEXT", "d": "TEXT"}
    rescued = inspect.typed(df, {"a": "INTEGER", "b": "REAL", "c": "INTEGER", "d": "TEXT"}).collect()
    assert rescued[0]["_rescued"] == '{"c":"x"}' and rescued[1]["_rescued"] is None


def test_sample_is_bounded_and_spread(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 900, F.col("id") % 4))
    out = sampling.stratified(df, ["g"], 100, "id").groupBy("g").count().collect()
    assert {r["g"] for r in out} == {0, 1, 2, 3} and all(r["count"] <= 25 for r in out)
    assert sampling.stratified(df, ["g"], 2000, "id").count() == 1000


def test_surrogate_keys_follow_the_order(spark):
    out = sampling.surrogate_key(spark.range(500).select((F.col("id") * 7 % 500).alias("v")), ["v"])
    assert sorted((r["v"], r["id"]) for r in out.collect()) == [(i, i + 1) for i in range(500)]


def test_surrogate_keys_lose_no_row(spark):
    """Many parts, coalesced by adaptive execution as far as it can: all ids from 1 to n, in order, nulls first, ties and equal rows too."""
    n = 40_000
    rows = spark.range(n).select(F.when(F.col("id") % 7 > 0, F.col("id") % 1000).alias("v"), F.repeat(F.lit("x"), 50).alias("pad"), F.lit(1).alias("_size"))
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        out = sampling.surrogate_key(rows, ["v"])
        assert out.columns == ["v", "pad", "_size", "id"]
        got = out.select("v", "id").orderBy("id").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r["id"] for r in got] == list(range(1, n + 1))
    assert [r["v"] for r in got] == sorted((r["v"] for r in got), key=lambda v: (v is not None, v or 0))
    assert sampling.surrogate_key(rows.limit(0), ["v"]).count() == 0


def test_timeseries_master(spark):
    a = spark.createDataFrame([("1", " S ", "01-02-2020 00:00", "3.5"), ("2", " S ", "01-02-2020 00:00", "3.5")], "SlNo string, Station string, Time string, `Level Hourly (m)` string")
    b = spark.createDataFrame([("S",)], "Station string")
    out = standardize.timeseries_master({"a": a, "b": b}, {"Station": "station", "Time": "observation_time"}, "Level", "level_m", {"station": "string", "block": "string", "level_m": "double", "measurement_type": "string", "year": "bigint", "source_file": "string"})
    assert [tuple(r) for r in out.collect()] == [("S", None, 3.5, "Hourly", 2020, "a")]


def test_header_falls_back(spark):
    cells = spark.createDataFrame([("s", 0, 0, "1"), ("s", 0, 1, "2"), ("s", 1, 0, "x")], "sheet string, row int, col int, value string")
    assert grid.detect_header_row(cells).first()["header_row"] == 0


def test_metrics_without_large_truths(spark):
    df = spark.createDataFrame([(0.1, 0.2)], "y double, p double")
    assert features.regression_metrics(df, "y", "p").first()["mape"] is None


def test_nearest_of_many(spark):
    df = spark.createDataFrame([(i, [float(i == k) for k in range(3)]) for i in range(3)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in V.top_k(df, [0.0, 1.0, 0.0], 2).collect()] == [1, 0]
    assert V.top_k(df, [0.0, 1.0, 0.0], 0).count() == 0
    with pytest.raises(ValueError):
        V.top_k(df, [1.0, 0.0])
    with pytest.raises(ValueError):
        V.embed_query(" \n")
    assert V.embed_query(" a b ") == pytest.approx(V.hashed_words(["a b"])[0].tolist())
    batch = V.top_k_batch(df, df.withColumnRenamed("vec_id", "query_id"), 1)
    assert {r["query_id"]: r["vec_id"] for r in batch.collect()} == {0: 0, 1: 1, 2: 2}


def test_vectors_without_direction(spark):
    """Null, zero and non-finite vectors, and those of another dimension, take no part, as rows and as queries."""
    odd = [(3, None), (4, [0.0, 0.0, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [None, 1.0, 0.0]), (7, [1.0, 2.0]), (8, [3.0, 6.0]), (9, []), (10, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 1.0, 0.0]), *odd], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], round(r["score"], 6)) for r in V.top_k(df, [1.0, 0.0, 0.0], 9).collect()] == [(0, 1.0), (10, 1.0), (2, 0.707107), (1, 0.0)]
    assert V.top_k(df, [0.0, 0.0, 0.0]).collect() == [] and V.top_k(df, [float("nan"), 0.0, 1.0]).collect() == []
    assert V.top_k(df.where("vec_id in (3, 4, 9)"), [1.0]).collect() == []
    for block, query_block in ((2048, 256), (2, 1)):
        batch = V.top_k_batch(df, df.withColumnRenamed("vec_id", "query_id"), 3, block, query_block).collect()
        found = {}
        for r in sorted(batch, key=lambda r: (r["query_id"], r["rank"])):
            assert -1 <= r["score"] <= 1
            found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert found == {0: [0, 10, 2], 10: [0, 10, 2], 1: [1, 2, 0], 2: [2, 0, 1], 7: [7, 8], 8: [7, 8]}


def test_an_id_that_many_rows_share_fills_no_block(spark):
    """A third of the rows have one id, half of these are copies of one row: blocks stay near their size, every row is in one, hits are whole."""
    rows = [(0, [1.0, i / 1000]) for i in range(1500)] + [(0, [1.0, 2.0])] * 1500 + [(i, [1.0, -i / 1000]) for i in range(1, 6001)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
    sizes = [r["n"] for r in V.blocked(df, "vec_id", 30, "block").select(F.size("block_rows").alias("n")).collect()]
    assert sum(sizes) == len(rows) and len(sizes) == 30 and max(sizes) < 3 * len(rows) / 30
    asked = spark.createDataFrame([(7, [1.0, 2.0]), (8, [1.0, -6.0])], "query_id long, embedding array<double>")
    found = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in V.top_k_batch(df, asked, 3, 300).orderBy("query_id", "rank").collect()]
    assert [x[:3] for x in found] == [(7, 1, 0), (7, 2, 0), (7, 3, 0), (8, 1, 6000), (8, 2, 5999), (8, 3, 5998)] and {x[3] for x in found[:4]} == {1.0}


def test_guarded_statements(spark, tmp_path):
    from pyspark.errors import AnalysisException

    spark.range(3).write.parquet(str(tmp_path / "good"))
    tables = {"good": str(tmp_path / "good")}
    spark.range(2).createOrReplaceTempView("secret")
    assert guards.run_read_only(spark, "SELECT count(*) AS n FROM good;", tables).first()["n"] == 3
    for bad in ("DROP TABLE good", "SELECT id FROM good, secret", "SELECT id FROM `secret`", "SELECT id FROM good JOIN default.secret USING (id)"):
        with pytest.raises(guards.Rejected):
            guards.run_read_only(spark, bad, tables)
    with pytest.raises(AnalysisException):  # a name that the patterns overlook
        guards.run_read_only(spark, "SELECT 1 FROM (SELECT 1 FROM good) x, secret", tables)


def test_text_tables_of_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("k,v\n1,é\n".encode())
    (tmp_path / "b.csv").write_bytes("k,v\n2,NA\n3,é\n".encode("latin-1"))
    rows = files.read_text_table(spark, str(tmp_path), files.NA_TOKENS).collect()
    assert {(r["k"], r["v"], r["source_file"]) for r in rows} == {("1", "é", "a.csv"), ("2", None, "b.csv"), ("3", "é", "b.csv")}
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "one file+x.csv").write_bytes(b"\xef\xbb\xbfk,v\n1,a\n")
    (tmp_path / "odd" / "two.csv").write_bytes("k,w\n2,\xe9\n".encode("latin-1"))
    rows = files.read_text_table(spark, str(tmp_path / "odd")).collect()
    assert {(r["k"], r["v"], r["w"]) for r in rows} == {("1", "a", None), ("2", None, "é")}
    (tmp_path / "empty").mkdir()
    assert files.read_text_table(spark, str(tmp_path / "empty")).collect() == []
    (tmp_path / "many").mkdir()
    (tmp_path / "many" / "a.csv").write_text('k,"a b",k,\n1,"x, ""y""",3,4\n\n1,2,3,4,5\n1,2\n5,,7,8\n', newline="\r\n")
    (tmp_path / "many" / "quoted.csv").write_text('k,note\n1,"two\nlines"\n')
    rows = files.read_text_table(spark, str(tmp_path / "many" / "a.csv"))
    assert rows.columns == ["k", "a b", "k2", "_c3", "source_file"]
    assert {tuple(r)[:4] for r in rows.collect()} == {("1", 'x, "y"', "3", "4"), ("5", None, "7", "8")}
    assert [(r["k"], r["note"]) for r in files.read_text_table(spark, str(tmp_path / "many" / "quoted.csv"), multi_line=True).collect()] == [("1", "two\nlines")]


def test_large_text_files_are_split(spark, tmp_path):
    """A Latin-1 file whose only telling line is its last one, read in many splits."""
    lines = [f"{k},Ã© {k}" for k in range(20000)]
    (tmp_path / "big.csv").write_bytes(("k,v\n" + "\n".join(lines) + "\n20000,\xe9\n").encode("latin-1"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = files.read_text_table(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert {(r["k"], r["v"]) for r in rows.collect()} == {(str(k), f"Ã© {k}") for k in range(20000)} | {("20000", "é")}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_workbooks_written_and_read(spark, tmp_path):
    book = files.workbook([["S.No", "a & <b>", None], [None, "  x ", "ä"], ["1"] + [str(k) for k in range(30)]])
    files.write_files(spark.createDataFrame([("in/x.xlsx", bytearray(book)), ("y.xlsx", bytearray(b"broken"))], "name string, content binary"), f"file://{tmp_path}")
    cells = {(r["row"], r["col"]): r["value"] for r in files.read_sheets(spark, str(tmp_path / "in")).collect()}
    assert (cells[0, 1], cells[1, 1], cells[1, 2], cells[2, 30]) == ("a & <b>", "  x ", "ä", "29") and len(cells) == 2 + 2 + 31
    assert sorted(p.name for p in tmp_path.rglob("*.xlsx")) == ["x.xlsx", "y.xlsx"] and files.read_sheets(spark, str(tmp_path / "*.xlsx")).collect() == []


def test_documentation_gaps(spark):
    from millrace.operators import inspect

    lines = spark.createDataFrame(list(enumerate(["# Title", "## a", "- x", "- gone", "## b", "- x", "## a", "## c"])), "place int, line string")
    columns = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("d", "z")], "section string, column_name string")
    want = {("a", None, "section repeated"), ("c", None, "section missing"), ("d", None, "section missing"), ("a", "gone", "column unknown"), ("a", "y", "column missing"), ("d", "z", "column missing")}
    got = {tuple(r) for r in inspect.documentation_gaps(lines, columns).collect()}
    assert got == want - {("c", None, "section missing")}


def test_sheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>S.No</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="AB2"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    assert {tuple(r) for r in files.read_sheets(spark, str(tmp_path)).collect()} == {("a.xlsx", "sheet1.xml", 1, 0, "S.No"), ("a.xlsx", "sheet1.xml", 1, 27, "7")}


def test_pages_keep_errors(spark):
    def broken(content):
        if content == b"x":
            raise ValueError("no")
        return [content.decode(), ""]

    docs = spark.createDataFrame([("a", bytearray(b"t")), ("b", bytearray(b"x"))], "doc_id string, content binary")
    assert {tuple(r) for r in files.extract_pages(docs, broken).collect()} == {("a", 1, "t", None), ("a", 2, "", None), ("b", 0, "", "ValueError: no")}


def test_discovery_and_loading(spark, tmp_path):
    (tmp_path / "in" / "kind").mkdir(parents=True)
    (tmp_path / "in" / "kind" / "a.txt").write_text("x")
    found = files.discover_documents(spark, str(tmp_path / "in"), "*.txt").first()
    assert (found["filename"], found["category"], found["size_bytes"]) == ("a.txt", "kind", 1)
    assert sinks.load_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    sinks.replace(spark.range(3), str(tmp_path / "t"))
    sinks.append(spark.range(2), str(tmp_path / "t"))
    assert sinks.load_or_empty(spark, str(tmp_path / "t"), "id long").count() == 5


def test_registered_candidates_have_the_full_sizes(spark, monkeypatch):
    from millrace.queries import features as Q

    seen = {}
    monkeypatch.setattr(Q, "split", lambda df, key: df)
    monkeypatch.setattr(Q.M, "fit_all", lambda task, train, models: seen.update(models))
    frames = type("Frames", (), {"where": lambda self, _: self, "drop": lambda self, _: self})()
    monkeypatch.setattr(Q, "F", type("Functions", (), {"col": staticmethod(lambda name: name)}))
    Q._trained(lambda name: frames)
    assert seen["forest"].getNumTrees() == 120 and seen["boosted"].getMaxIter() == 150


def test_models_are_kept(spark, tmp_path):
    from millrace.operators import ml

    rows = spark.range(40).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), (F.col("id") % 3).cast("double").alias("extra"))
    task = ml.effective_task(ml.Task("y", ("x",)), rows, ("extra", "lost"))
    assert task.numeric == ("x", "extra")
    model = ml.fit_all(task, rows, {"linear": ml.candidates(task)["linear"]}).models["linear"]
    folder = str(tmp_path / "kept")
    for n in (1, 2):
        ml.save_model(spark, model, folder, {"rows": n, "features": list(task.numeric)})
    again, metadata = ml.load_model(spark, folder)
    assert metadata == {"rows": 2, "features": ["x", "extra"]}
    values = lambda m: [r["prediction"] for r in m.transform(task.prepared(rows)).orderBy("x").collect()]
    assert values(again) == pytest.approx(values(model))
    with pytest.raises(FileNotFoundError):
        ml.load_model(spark, str(tmp_path / "none"))


def test_rows_of_a_small_file_use_all_cores(spark):
    from millrace.operators import ml

    rows = spark.range(100, numPartitions=1)
    dealt = ml.spread(rows, least=30)
    assert dealt.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in dealt.collect()) == list(range(100))
    assert ml.spread(rows).rdd.getNumPartitions() == 1
