"""Sessions over their life: what each event finds, and what is left."""

from millrace.plans import memory as M

SCHEMA = "conv_id long, seq long, op string, key string, value string"
EVENTS = [
    (1, 1, "clear", None, None), (1, 2, "create", None, None), (1, 3, "put", "user", "a"), (1, 4, "note", "unit", "m"), (1, 5, "create", None, None),
    (1, 6, "put", "assistant", "b"), (1, 7, "clear", None, None), (1, 8, "put", "user", "c"), (1, 9, "note", "unit", "mm"), (1, 10, "get", None, None),
    (2, 1, "put", "user", "lost"), (2, 2, "delete", None, None), (2, 3, "get", None, None),
    (3, 1, "create", None, None), (3, 2, "note", "unit", "m"), (3, 3, "delete", None, None), (3, 4, "put", "user", "lost"), (3, 5, "create", None, None), (3, 6, "get", None, None),
    (4, 1, "create", None, None), (4, 2, "put", "user", "x"), (4, 3, "delete", None, None),
]


def test_replay(spark):
    got = {(r["conv_id"], r["seq"]): r["status"] for r in M.replay(spark.createDataFrame(EVENTS, SCHEMA)).collect()}
    want = "NOT_FOUND CREATED STORED STORED DUPLICATE STORED CLEARED STORED STORED FOUND NOT_FOUND NOT_FOUND NOT_FOUND CREATED STORED DELETED NOT_FOUND CREATED FOUND CREATED STORED DELETED"
    assert got == dict(zip(((c, s) for c, s, *_ in EVENTS), want.split(), strict=True))


def test_table(spark):
    rows = M.session_table(spark.createDataFrame(EVENTS, SCHEMA)).collect()
    assert {(r["conv_id"], r["messages"], r["last_user"], tuple(r["metadata"].items())) for r in rows} == {(1, 1, "c", (("unit", "mm"),)), (3, 0, None, ())}


def test_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert M.replay(none).collect() == [] and M.session_table(none).collect() == []
