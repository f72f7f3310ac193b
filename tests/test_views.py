"""Merging, targets, configuration, streaming, and all queries against DuckDB."""

import json
import random
import re
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import queries
from docloom.functions.transforms import Transform
from docloom.operators import children as rel
from docloom.operators import merge
from docloom.operators.store import Store, TooManyRejects
from docloom.plans import admin
from docloom.plans.changes import ChangePlan, document_type
from docloom.plans.config import ChildRule, ConfigError, CountRule, FanOutRule, JoinRule, View, as_json, check, documents, from_toml
from docloom.sources import readers
from docloom.sources.changelog import log_rows, roles
from docloom.streaming import apply, polls

DATA = "/root/testdata/sf0.001"
OPS = "index string, id string, routing string, action string, doc struct<x:int>, version long, seq long"


def op(id, version, seq, action="upsert", index="i"):
    return (index, id, None, action, (seq,) if action == "upsert" else None, version, seq)


def fold(ops):
    """Arrival order: an operation applies if either version is null or the stored one is not larger."""
    state = {}
    for o in sorted(ops, key=lambda o: o[6]):
        old = state.get(o[1])
        if old is None or old[5] is None or o[5] is None or old[5] <= o[5]:
            state[o[1]] = o
    return {k: (v[3], v[5], v[6]) for k, v in state.items()}


def state_of(df):
    return {r["id"]: (r["action"], r["version"], r["seq"]) for r in df.collect()}


def test_merge_equals_arrival_order(spark):
    r = random.Random(1)
    ops = [op(str(k), r.choice([None, 1, 2, 3, 3, 4]), 1000 * k + s, r.choice(["upsert", "delete"])) for k in range(300) for s in range(r.randrange(1, 7))]
    df = spark.createDataFrame(ops, OPS)
    assert state_of(merge.winners(df)) == fold(ops)
    cut = lambda o: o[6] % 1000 < 3
    first = merge.winners(spark.createDataFrame([o for o in ops if cut(o)], OPS))
    assert state_of(merge.merge(first, spark.createDataFrame([o for o in ops if not cut(o)], OPS))) == fold(ops)


@given(st.randoms())
@settings(max_examples=3, deadline=None)
def test_versioned_replay_in_any_order(spark, r):
    ops = [op(str(r.randrange(20)), r.randrange(1, 30), n, r.choice(["upsert", "delete"])) for n in range(120)]
    again = ops + r.sample(ops, 40)
    r.shuffle(again)
    df = spark.createDataFrame(again, OPS)
    assert state_of(merge.versioned_winners(df)) == state_of(merge.winners(spark.createDataFrame(ops, OPS)))


KIND = T.StructType([T.StructField("x", T.IntegerType())])


@pytest.fixture
def target(spark, tmp_path):
    t = Store(spark, f"file://{tmp_path}/t", KIND, buckets=4)
    t.prepare()
    return t


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("profile", ["versioned", "positional", "last_write"])
def test_store_contract(spark, tmp_path, profile):
    """What each profile promises: idempotent batches, the order of writes, truncates, keys, names, notes, rejects."""
    t = Store(spark, f"file://{tmp_path}/{profile}", KIND, profile, buckets=4)
    assert t.prepare() == [] and t.size("i") is None and t.rejected().count() == 0
    ops = spark.createDataFrame([op("a", 10, 1), op("b", 20, 2), op("a", 5, 3), op("c", 30, 4, index="j")], OPS)
    assert t.apply(ops, stream="s", epoch=0, position=30) and not t.apply(ops, stream="s", epoch=0, position=99)
    assert t.position("s") == 30 and t.position("other") is None and t.applied("s", 0) and not t.applied("s", 1)
    kept = {r["id"]: r["version"] for r in t.documents("i").collect()}
    assert kept == ({"a": 10, "b": 20} if profile == "versioned" else {"a": 5, "b": 20})
    t.apply(ops)  # once more, without an epoch
    assert {r["id"]: r["version"] for r in t.documents("i").collect()} == kept
    keys = spark.createDataFrame([(0, "i", "b", None), (1, "i", "zz", None), (2, "j", "c", None)], "n int, index string, id string, routing string")
    assert [(r["n"], r["version"], r["doc"] and r["doc"]["x"]) for r in t.lookup(keys).orderBy("n").collect()] == [(0, 20, 2), (1, None, None), (2, 30, 4)]
    assert ids(t.page("i", "a", 5)) == ["b"] and {r["index"]: r["n"] for r in t.totals().collect()} == {"i": 2, "j": 1}
    t.truncate("i*", 10)
    assert ids(t.documents("i")) == ([] if profile == "last_write" else ["b"])
    t.apply(spark.createDataFrame([op("a", 9, 9), op("z", 11, 10)], OPS))  # one below the truncate, one above
    assert ids(t.documents("i")) == {"versioned": ["b", "z"], "positional": ["b", "z"], "last_write": ["a", "z"]}[profile]
    t.name("now", "j")
    assert t.size("now") == 1 and t.named("now") == "j"
    with pytest.raises(ValueError):
        t.name("i", "j")
    t.remove("j")
    assert t.size("j") is None and t.size("i")
    t.advance("s", 77)
    t.set_note("n", {"at": 1})
    assert t.position("s") == 77 and t.note("n") == {"at": 1}
    t.set_note("n", None)
    assert t.note("n") is None
    assert t.prepare(T.StructType([T.StructField("y", T.IntegerType())])) == ["y"]
    with pytest.raises(ValueError):
        t.prepare(T.StructType([T.StructField("x", T.StringType())]))
    bad = spark.createDataFrame([op("d", 90, 90), op("e/e", 91, 91)], OPS).withColumn("reject", F.when(F.col("id") != "d", "bad"))
    with pytest.raises(TooManyRejects):
        t.apply(bad)
    if profile == "last_write":  # it can't put anything aside
        with pytest.raises(TooManyRejects):
            t.apply(bad, max_rejects=5)
        return
    for _ in range(2):  # a repeated batch is no second reject
        t.apply(bad, max_rejects=1)
    rows, n = t.newest_rejects(10)
    assert n == 1 and rows.first()["reject_id"] == "i-e_e" and t.lookup(keys.limit(1)).count() == 1
    t.retry_rejects()
    assert "e/e" in ids(t.documents("i")) and t.rejected().count() == 0


def test_a_batch_leaves_other_buckets_alone(spark, target):
    many = spark.createDataFrame([op(str(i), 1, i) for i in range(50)], OPS)
    target.apply(many)
    before = target.manifest()["files"]
    target.apply(spark.createDataFrame([op("7", 2, 99)], OPS))
    after = target.manifest()["files"]
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert target.documents("i").count() == 50 and len(target.manifest()["retired"]) == 1
    target.grace = 0.0
    target.apply(spark.createDataFrame([op("7", 3, 100)], OPS))
    assert target.manifest()["retired"] == [] and target.documents("i").count() == 50


def test_truncate_within_a_batch(spark, target):
    """A row of the truncate's own version that comes after it in the log stays, one before it goes; a loaded one stays."""
    cut = ("i", None, None, "truncate", None, 50, 500)
    target.apply(spark.createDataFrame([op("old", 40, 1), op("same", 50, 499), cut, op("later", 50, 501), op("load", 50, -1), op("stale", 49, -1)], OPS))
    assert ids(target.documents("i")) == ["later", "load"]


def test_script_of_changes(spark, target):
    """Insert, update, stale loads, delete, insert again, move, truncate, unversioned write."""
    script = [
        op("k1", 10, 1), op("k1", 20, 2), op("k1", 15, -1), op("k1", 30, 3, "delete"), op("k1", 25, -1), op("k1", 30, 4),
        op("k2", 35, 5), op("k3", 40, 6), op("k2", 40, 7, "delete"), ("i", None, None, "truncate", None, 50, 8), op("k4", 60, 9), op("k5", None, 10),
    ]
    for n, batch in enumerate((script[:6], script[6:9], script[9:])):
        target.apply(spark.createDataFrame(batch, OPS), stream="s", epoch=n)
        if n == 0:
            assert ids(target.documents("i")) == ["k1"]
        if n == 1:
            assert ids(target.documents("i")) == ["k1", "k3"]
    assert ids(target.documents("i")) == ["k4", "k5"]
    target.apply(spark.createDataFrame([op("k9", 20, 11)], OPS))
    assert ids(target.documents("i")) == ["k4", "k5"]


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("up", T.LongType()), T.StructField("name", T.StringType()), T.StructField("price", T.DecimalType(10, 2))])
SHOP = """
[[sync.tables]]
table = "shops"
index = "shop"
id = "s{id}"
key = ["id"]
[sync.tables.join]
name = "shop"
[[sync.tables]]
table = "items"
index = "shop"
id = "i{id}"
key = ["id"]
[sync.tables.join]
name = "item"
parent_key = "up"
"""


def log_of(spark, changes):
    """(table, op, before, after, version, txn, seq) as a log; a commit has no op."""
    rows = spark.createDataFrame([(t, o, b and (*b, None)[:4], a and (*a, None)[:4], v, x, s) for t, o, b, a, v, x, s in changes], T.StructType([
        T.StructField("table", T.StringType()), T.StructField("op", T.StringType()), T.StructField("before", ROW), T.StructField("after", ROW),
        T.StructField("version", T.LongType()), T.StructField("txn_id", T.LongType()), T.StructField("seq", T.LongType())]))
    made = [log_rows(rows.where((F.col("table") == t) & F.col("op").isNotNull()), "public", t) for t in ("shops", "items")]
    ends = rows.where(F.col("op").isNull()).select(F.lit("commit").alias("kind"), "version", "txn_id", "seq")
    return made[0].unionByName(made[1]).unionByName(ends, allowMissingColumns=True)


def test_joined_views_follow_their_log(spark, tmp_path):
    """Children lie under their parent's id by its own rule; a parent's delete takes them; a move changes their shard."""
    views = from_toml(SHOP)
    tables = {t: spark.createDataFrame([], ROW) for t in ("shops", "items")}
    doc = document_type(views, tables)
    store = Store(spark, f"file://{tmp_path}/s", doc, buckets=4)
    plan = ChangePlan(views, {t: ROW for t in tables}, lambda: tables, doc, store.lookup)
    assert plan.skipped_truncates() == []
    none = None
    first = [("shops", "insert", none, (1, 0, "a"), 1, none, 1), ("shops", "insert", none, (2, 0, "b"), 2, none, 2)]
    first += [("items", "insert", none, (n, 1 + n % 2, "x"), 3, none, 10 + n) for n in range(6)]
    store.apply(plan(log_of(spark, first)))
    found = {r["id"]: (r["routing"], r["doc"]["join"]["name"], r["doc"]["join"]["parent"]) for r in store.documents("shop").collect()}
    assert found["s1"] == (None, "shop", None) and found["i0"] == ("s1", "item", "s1") and len(found) == 8
    store.apply(plan(log_of(spark, [("items", "update", (0, 1, "x"), (0, 2, "y"), 4, none, 20), ("shops", "delete", (1, 0, "a"), none, 5, none, 21), ("items", "insert", none, (9, 1, "z"), 6, none, 22)])))
    found = {r["id"]: (r["routing"], r["doc"]["name"]) for r in store.documents("shop").collect()}
    assert found == {"s2": (None, "b"), "i0": ("s2", "y"), "i1": ("s2", "x"), "i3": ("s2", "x"), "i5": ("s2", "x"), "i9": ("s1", "z")}
    cut = log_of(spark, []).unionByName(spark.createDataFrame([("truncate", "public", "items", 9, 30)], "kind string, schema string, table string, version long, seq long"), allowMissingColumns=True)
    store.apply(plan(cut))
    assert ids(store.documents("shop")) == ["s2"]
    with pytest.raises(Exception, match="parent"):
        store.apply(plan(log_of(spark, [("items", "insert", none, (7, none, "x"), 10, none, 40)])))


def test_transactions_over_batches(spark, tmp_path):
    """A transaction cut by the batches' borders is seen when its end comes, once, and holds the position back."""
    view = View("shops", "shop", key=["id"])
    tables = {"shops": spark.createDataFrame([], ROW)}
    store = Store(spark, f"file://{tmp_path}/s", document_type([view], tables), buckets=2)
    parts = [
        [("shops", "insert", None, (1, 0, "a"), 1, 7, 1), ("shops", "insert", None, (2, 0, "b"), 2, 8, 2), ("x", None, None, None, 3, 8, 3)],
        [("shops", "insert", None, (3, 0, "c"), 4, 7, 4)],
        [("x", None, None, None, 5, 7, 5)],
    ]
    plan = ChangePlan([view], {"shops": ROW}, lambda: tables, store.doc, store.lookup)
    seen = []
    for part in parts:
        log_of(spark, part).repartition(1).write.mode("append").parquet(f"{tmp_path}/log")
        stream = apply.read_changes(spark, f"{tmp_path}/log", log_of(spark, part).schema, 1)
        apply.run(stream, store, lambda: plan, "s", f"{tmp_path}/check").awaitTermination()
        seen.append((ids(store.documents("shop")), store.position("s")))
    assert seen == [(["2"], 3), (["2"], 3), (["1", "2", "3"], 5)]
    assert apply.wait_for(store, "s", 5, 1.0) and not apply.wait_for(store, "s", 6, 0.1)


def test_idle_streams_move_on(spark, tmp_path):
    """A row of kind position moves the stream on, but never past a transaction that is still open."""
    view = View("shops", "shop", key=["id"])
    tables = {"shops": spark.createDataFrame([], ROW)}
    store = Store(spark, f"file://{tmp_path}/s", document_type([view], tables), buckets=2)
    plan = ChangePlan([view], {"shops": ROW}, lambda: tables, store.doc, store.lookup)
    beat = lambda at: spark.createDataFrame([("position", at, at)], "kind string, version long, seq long")
    seen = []
    for part in (beat(5), log_of(spark, [("shops", "insert", None, (1, 0, "a"), 6, 7, 6)]), beat(8), log_of(spark, [("x", None, None, None, 9, 7, 9)]), beat(10)):
        log_of(spark, []).unionByName(part, allowMissingColumns=True).repartition(1).write.mode("append").parquet(f"{tmp_path}/log")
        apply.run(apply.read_changes(spark, f"{tmp_path}/log", log_of(spark, []).schema, 1), store, lambda: plan, "s", f"{tmp_path}/check").awaitTermination()
        seen.append(store.position("s"))
    assert seen == [5, 5, 5, 9, 10] and ids(store.documents("shop")) == ["1"]


POLLED = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("gone", T.BooleanType()), T.StructField("at", T.TimestampType())])


@pytest.mark.parametrize("page", [None, 1, 2, 100])
def test_polls_take_in_what_is_new(spark, tmp_path, page):
    """Ties are never cut, late ties are seen, null values never; flagged rows and rows that leave the filter go; a poll repeated whole changes nothing."""
    view = View("t", "docs", key=["id"], where="name <> 'out'", soft_delete="gone", poll_column="at", exclude=["at", "gone"])
    now = {}
    store = Store(spark, f"file://{tmp_path}/s", document_type([view], {"t": spark.createDataFrame([], POLLED)}), buckets=2)
    plan = ChangePlan([view], {"t": POLLED}, lambda: {"t": table()}, store.doc, store.lookup)

    def table():
        rows = [(i, n, g, None if at is None else datetime(2024, 10, 27, 0, 59, 59, at)) for i, (n, g, at) in now.items()]
        return spark.createDataFrame(rows, POLLED)

    def polled():
        pages = polls.follow([view], lambda: {"t": table()}, store, lambda: plan, page)
        held = {r["id"]: r["doc"]["name"] for r in store.documents("docs").collect()}
        want = {str(i): n for i, (n, g, at) in now.items() if not g and at is not None and n != "out"}
        assert held == want
        return pages

    assert polled() == 0 and polls.watermark(view, store) is None
    now |= {1: ("a", False, 1), 2: ("b", False, 2), 3: ("c", False, 2), 4: ("d", True, 3), 5: ("out", False, 3), 6: ("null", False, None)}
    assert polled() == {None: 1, 1: 3, 2: 2, 100: 1}[page]
    before = polls.watermark(view, store)
    assert before["ties"] == 2 and polled() == 0
    now |= {7: ("late", False, 3)}  # another row of the watermark's own value
    assert polled() == 1 and polls.watermark(view, store) == before | {"ties": 3}
    now |= {1: ("a2", False, 4), 2: ("b", True, 5), 3: ("out", None, 6), 5: ("in", False, 6), 4: ("back", False, 7)}
    assert polled() == {None: 1, 1: 4, 2: 3, 100: 1}[page] and polled() == 0
    count = store.counts("poll-public.t")
    store.set_note("poll-public.t", before)  # as if those polls had not been
    polled()
    assert store.counts("poll-public.t")["batches"] > count["batches"] and count["unversioned"] == count["operations"] > count["deletes"] > 0


@pytest.mark.parametrize("kind, values", [("timestamp", "timestamp'2024-10-27 02:30:00.000001'"), ("timestamp_ntz", "timestamp_ntz'2024-10-27 02:30:00.5'"), ("date", "date'2024-01-02'"), ("long", "9007199254740993L"), ("decimal(20,3)", "12345678901234567.125BD"), ("string", "'b'"), ("double", "0.1D")])
def test_watermarks_keep_their_value(spark, kind, values):
    row = spark.sql(f"SELECT CAST({values} AS {kind}) AS v")
    text = row.select(polls.as_text(F.col("v"), row.schema["v"].dataType).alias("t")).first()["t"]
    assert row.where(F.col("v") == polls.from_text(text, row.schema["v"].dataType)).count() == 1


def test_polls_prune_their_scan(spark, tmp_path):
    """Only rows past the watermark are asked of the files."""
    rows = spark.read.parquet(f"{DATA}/events.parquet")
    since = polls.from_text("500", T.LongType())
    plan = rows.where(F.col("event_id") > since).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(event_id,500)" in plan and "ReadSchema: struct<event_id:bigint>" in plan


def test_left_out_columns_are_completed(spark, tmp_path):
    """Columns that the log left out: from this batch, else from the store; a transformed one keeps its stored form, a filter reads the whole row."""
    view = View("shops", "shop", key=["id"], where="up > 0", transform={"name": Transform("redact")}, rename={"price": "cost"})
    tables = {"shops": spark.createDataFrame([], ROW)}
    store = Store(spark, f"file://{tmp_path}/s", document_type([view], tables), buckets=2)
    plan = ChangePlan([view], {"shops": ROW}, lambda: tables, store.doc, store.lookup)
    image = lambda *v: json.dumps(dict(zip(("id", "up", "name", "price"), v, strict=True)))
    key = lambda i: json.dumps({"id": i})
    kind = "kind string, schema string, table string, op string, key string, old_key string, before string, after string, unchanged array<string>, version long, txn_id long, seq long"
    row = lambda op, i, after, left_out, at, old=None: ("row", "public", "shops", op, key(i), old, None, after, left_out, at, None, at)
    store.apply(plan(spark.createDataFrame([row("insert", 1, image(1, 5, "a", 1.5), [], 1), row("insert", 2, image(2, 6, "b", 2.5), [], 2)], kind)))
    store.apply(plan(spark.createDataFrame([
        row("update", 1, image(1, None, None, 9.0), ["up", "name"], 3),  # from the store
        row("update", 3, image(3, 7, None, None), ["name", "price"], 4, key(2)),  # moved, from the store
        row("insert", 4, image(4, 8, "c", 4.5), [], 5), row("update", 4, image(4, None, None, 5.5), ["up", "name"], 6),  # from this batch
        row("insert", 5, image(5, 9, "d", 1.0), [], 7), row("update", 5, image(5, -1, None, None), ["name", "price"], 8),  # leaves the filter
    ], kind)))
    found = {r["id"]: (r["doc"]["up"], r["doc"]["name"], float(r["doc"]["cost"])) for r in store.documents("shop").collect()}
    assert found == {"1": (5, "***", 9.0), "3": (7, "***", 2.5), "4": (8, "***", 5.5)}


def test_append_only_and_partial_rows(spark, tmp_path):
    view = View("shops", "shop", append_only=True)
    tables = {"shops": spark.createDataFrame([], ROW)}
    plan = ChangePlan([view], {"shops": ROW}, lambda: tables, document_type([view], tables))
    twice = [("shops", "insert", None, (1, 0, "a"), v, None, v) for v in (1, 2)]
    assert plan(log_of(spark, twice)).select("id").distinct().count() == 1
    with pytest.raises(Exception, match="append-only"):
        plan(log_of(spark, [("shops", "delete", (1, 0, "a"), None, 3, None, 3)])).collect()


def test_related_changes_name_their_parents(spark, tmp_path):
    """A child's new and old parent are written anew at its version, through a junction too; one that changed itself isn't."""
    rows = spark.createDataFrame
    shops = rows([(i, 0, "s", None) for i in range(5)], ROW)
    items, pairs = rows([(10, 1, "x", None), (11, 2, "y", None)], ROW), rows([(100, 3, "10", None), (101, 4, "11", None)], ROW).withColumn("child", F.col("name").cast("long")).drop("name", "price")
    view = View("shops", "shop", key=["id"], where="id < 5", children=[ChildRule("items", "items", "up", order=["id"]), ChildRule("many", "items", "id", order=["id"], through_table="pairs", through_parent_key="up", through_child_key="child")])
    tables = {"shops": shops, "items": items, "pairs": pairs}
    plan = ChangePlan([view], {t: df.schema for t, df in tables.items()}, lambda: tables, document_type([view], tables))
    log = log_of(spark, [("items", "update", (10, 2, "x"), (10, 1, "x"), 7, None, 1), ("shops", "update", (2, 0, "t"), (2, 0, "s"), 6, None, 2)])
    got = {r["id"]: (r["version"], [x["id"] for x in r["doc"]["items"]], [x["id"] for x in r["doc"]["many"]]) for r in plan(log).collect()}
    assert got == {"1": (7, [10], []), "2": (6, [11], []), "3": (7, [], [10])}
    emptied = log.limit(0).unionByName(rows([("truncate", "public", "pairs", 9, 9)], "kind string, schema string, table string, version long, seq long"), allowMissingColumns=True)
    assert sorted(r["id"] for r in plan(emptied).collect()) == ["0", "1", "2", "3", "4"]
    assert roles("items", [view]) == {"public.shops": ["parent", "through"]} and roles("pairs", [view]) == {"public.shops": ["junction"]}


def test_json_documents(spark):
    view = View("shops", "shop", key=["id"], soft_delete="name = 'gone'", children=[ChildRule("part", "items", "up", ["id"], columns=["name", "price"], single=True, flatten=True, rename={"name": "part", "price": "cost"})])
    shops = spark.createDataFrame([(1, None, None, Decimal("9.90")), (2, 5, "gone", None), (3, 5, 'q"', None)], ROW)
    items = spark.createDataFrame([(7, 3, None, Decimal("1.50"))], ROW)
    got = {r["_id"]: r["json"] for r in as_json(documents(view, {"shops": shops, "items": items})).collect()}
    assert got == {"1": '{"id":1,"name":null,"price":"9.90","up":null}', "3": '{"cost":"1.50","id":3,"name":"q\\"","part":null,"price":null,"up":5}'}
    odd = spark.createDataFrame([(1, float("nan"))], "id int, x double")
    with pytest.raises(Exception, match="JSON"):
        as_json(documents(View("o", "o", key=["id"]), {"o": odd})).collect()
    nested = spark.createDataFrame([(1, [True, None], {"b": 2.5}, bytearray(b"hi"))], "id int, a array<boolean>, m map<string,double>, z binary")
    assert as_json(documents(View("o", "o", key=["id"]), {"o": nested})).first()["json"] == '{"a":[true,null],"id":1,"m":{"b":2.5},"z":"aGk="}'


def test_load_in_waves_goes_on(spark, tmp_path):
    view = View("nation", "nations", key=["n_nationkey"])
    nation = spark.read.parquet(f"{DATA}/nation.parquet")
    store = Store(spark, f"file://{tmp_path}/n", nation.schema, buckets=2)
    whole = store.apply
    store.apply = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")) if store.manifest()["commit"] == 1 else whole(*a, **k)
    with pytest.raises(RuntimeError):
        admin.load_ranges(view, {"nation": nation}, store, [5, 10, 20], 7, at_once=2)
    assert store.size("nations") == 10 and not admin.loaded(view, store)
    store.apply = whole
    with pytest.raises(ValueError):
        admin.load_ranges(view, {"nation": nation}, store, [6], 9)
    assert admin.load_ranges(view, {"nation": nation}, store, [5, 10, 20], 9, at_once=2) == 1
    assert store.size("nations") == 25 and {r["version"] for r in store.documents().select("version").distinct().collect()} == {7} and admin.loaded(view, store)
    region = spark.read.parquet(f"{DATA}/region.parquet")
    assert admin.admit([view, View("region", "regions", key=["r_regionkey"])], {"nation": nation, "region": region.selectExpr("r_regionkey", "r_name AS n_name")}, store, 8) == ["public.region"]


def test_queries_are_retried_and_isolated():
    class Failing:
        def __init__(self, times):
            self.left = times

        def awaitTermination(self):
            self.left -= 1
            if self.left >= 0:
                raise RuntimeError("down")

    one, waits = Failing(3), []
    assert apply.retried(lambda: one, attempts=5, pause=waits.append) is one and waits == [1.0, 2.0, 4.0]
    with pytest.raises(RuntimeError):
        apply.retried(lambda: Failing(9), attempts=2, pause=waits.append)
    assert apply.run_all({"a": lambda: Failing(0), "b": lambda: Failing(1), "c": lambda: 1 / 0}) == {"a": None, "b": "down", "c": "division by zero"}


def test_plans_shuffle_little(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    capped = plan(rel.collected(rel.Child("orders", orders, "o_custkey", ["o_orderkey"], max_rows=3)))
    assert capped.count("Exchange") == 1 and "WindowGroupLimit" in capped and capped.count("Scan parquet") == 1
    view = plan(queries.customer_view(spark, DATA))
    assert len(re.findall(r"[^t]HashAggregate\(keys=\[_fk", view)) == 2 and "LeftSemi" in view  # one aggregate for total and count, of the parents asked for
    ops = spark.createDataFrame([op("a", 1, 1)], OPS)
    merged = plan(merge.winners(ops))
    assert merged.count("Exchange") == 1 and "Join" not in merged


TOML = """
[[sync.tables]]
table = "customer"
index = "customers"
key = ["c_custkey"]
where = "c_acctbal > 0"
exclude = ["c_nationkey"]
[sync.tables.transform]
c_name = {op = "redact"}
[[sync.tables.children]]
field = "orders"
table = "orders"
key = "o_custkey"
order = ["o_orderkey"]
max_rows = 2
"""


def test_configuration(spark, target, tmp_path):
    (view,) = from_toml(TOML)
    tables = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("customer", "orders")}
    docs = documents(view, tables)
    assert docs.where("c_name <> '***' OR size(orders) > 2 OR c_acctbal <= 0").count() == 0
    assert "orders_truncated" in as_json(docs).where("json like '%orders_truncated%'").first()["json"]
    assert "c_acctbal" in docs._jdf.queryExecution().optimizedPlan().toString()
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)" in plan and "Python" not in plan
    faulty = View("t", "Bad Name", key=["k"], columns=["a"], exclude=["b"], where="a LIKE 'x'", rename={"a": "z", "b": "z"})
    with pytest.raises(ConfigError) as e:
        check([faulty])
    assert all(x in str(e.value) for x in ("index name", "together", "LIKE", "one name"))


@pytest.mark.parametrize(
    "views, fault",
    [
        ([View("t", "t", key=["a", "b"], counts=[CountRule("n", "c", "k")])], "one column"),
        ([View("t", "t", key=["a", "b"], children=[ChildRule("n", "c", "k")])], "one column"),
        ([View("t", "t", key=["a", "b"], join=JoinRule("p"))], "one column"),
        ([View("t", "t", key=["a"], append_only=True)], "without a key"),
        ([View("t", "t", append_only=True, poll_column="a")], "polled again"),
        ([View("t", "t-{x}", key=["a"]), View("u", "t-new", key=["a"])], "other's index"),
        ([View("t", "t", key=["a"], id="{a}", join=JoinRule("c", parent_key="p"))], "no parents"),
        ([View("t", "t", key=["a"], id="{b}", join=JoinRule("p")), View("u", "t", key=["a"], id="{a}", join=JoinRule("c", parent_key="t"))], "more than their key"),
        ([View("t", "t", key=["a"], fan_out=FanOutRule("x", "constant"))], "names no column"),
        ([View("t", "t", key=["a"]), View("u", "t", key=["a"])], "share an index"),
    ],
)
def test_refused_views(views, fault):
    with pytest.raises(ConfigError, match=fault):
        check(views)


def test_unsafe_edits():
    old = [View("t", "t", key=["a"]), View("u", "u", key=["a"])]
    new = [View("t", "t", key=["a"], where="a > 1", exclude=["b"]), View("v", "v", key=["a"])]
    assert admin.unsafe_edits(old, old) == []
    assert admin.unsafe_edits(old, new) == ["public.t: where changed", "public.v: a new table or index", "public.u: no longer written to u"]


def test_administration(spark, tmp_path):
    view = View("nation", "nations", key=["n_nationkey"])
    nation = spark.read.parquet(f"{DATA}/nation.parquet")
    t = Store(spark, f"file://{tmp_path}/n", nation.schema)
    t.prepare()
    admin.load(view, {"nation": nation}, t, version=5)
    fewer = {"nation": nation.where("n_nationkey < 20")}
    assert admin.reconcile(view, fewer, t) == (25, 5)
    assert admin.reconcile(view, fewer, t, delete=True) == (25, 5)
    assert t.size("nations") == 20
    assert admin.reindex(view, fewer, t, "nations-now") == "exact"
    assert t.named("nations-now").startswith("nations-now-") and t.size("nations-now") == 20
    t.advance("s", 5)
    assert admin.status(t, "s", 9) == {"acked": 5, "caught_up": False, "behind": 4, "rejects": 0}
    split = View("nation", "n-{n_regionkey}", key=["n_nationkey"])
    admin.load(split, {"nation": nation}, t, extra="n_regionkey < 2")
    assert admin.reconcile(split, {"nation": nation.where("n_regionkey = 0")}, t, delete=True) == (10, 5)
    assert t.size("n-0") == 5 and t.size("n-1") is None
    assert [admin.verdict(*x) for x in ((5, 5, 5), (5, 5, 4), (5, 8, 6), (5, 8, 9))] == ["exact", "mismatch", "within_drift", "mismatch"]
    assert [admin.resume(*x) for x in ((None, "s", 0, True), (("s", 5), "s", 9, True), (("s", 5), "s", 1, False), (("s", 5), "s", 1, True))] == ["load", "load", "continue_load", "stream"]


def test_open_transactions_wait(spark):
    rows = [("row", 1, 10, "a"), ("row", 2, 11, "b"), ("commit", 1, 12, None)]
    schema = "kind string, txn_id long, version long, id string"
    done, waiting = apply.complete_transactions(spark.createDataFrame(rows, schema), None)
    assert [(r["id"], r["commit_lsn"]) for r in done.collect()] == [("a", 12)]
    done, waiting = apply.complete_transactions(spark.createDataFrame([("commit", 2, 20, None)], schema), waiting)
    assert [(r["id"], r["commit_lsn"]) for r in done.collect()] == [("b", 20)] and waiting.count() == 0


def test_ranges_and_pages(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    ends = readers.bounds(df, "k", 4, share=1.0)
    assert sum(df.where(readers.in_range("k", a, b)).count() for a, b in readers.ranges_of(ends)) == 100 and len(ends) == 3
    assert [r["k"] for r in readers.key_page(df, ["k"], [97], 5).collect()] == [98, 99]
    path = df.limit(0)
    assert readers.bounds(path, "k", 4) == []


def test_command_line(spark, tmp_path, capsys):
    from docloom.__main__ import main

    def said():
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    config, broken = tmp_path / "shop.toml", tmp_path / "broken.toml"
    spark.read.parquet(f"{DATA}/nation.parquet").limit(20).write.parquet(f"file://{tmp_path}/data/nation.parquet")
    config.write_text(f"""
[source]
tables = "file://{tmp_path}/data"
changes = "file://{tmp_path}/log"
[store]
root = "file://{tmp_path}/views"
buckets = 2
[[sync.tables]]
table = "nation"
index = "nations"
key = ["n_nationkey"]
""")
    broken.write_text('[source]\ntables = "x"\n[store]\nroot = "y"\n[[sync.tables]]\ntable = "t"\nindex = "Bad"\nkey = ["k"]\n')
    assert main(["example"]) == 0 and "[[sync.tables]]" in capsys.readouterr().out
    assert main(["validate", str(config)]) == 0 and main(["validate", str(config), str(broken)]) == 2
    assert "index name" in said()[0]["fault"]
    row = spark.read.parquet(f"{tmp_path}/data/nation.parquet").schema
    change = spark.createDataFrame([("insert", (90, "NEW", 1), 5, 5), ("delete", (90, "NEW", 1), 6, 6), ("insert", (91, "NEWER", 1), 7, 7)], T.StructType([T.StructField("op", T.StringType()), T.StructField("after", row), T.StructField("version", T.LongType()), T.StructField("seq", T.LongType())]))
    made = change.withColumns({"key": F.struct(F.col("after.n_nationkey").alias("n_nationkey")), "after": F.when(F.col("op") == "insert", F.col("after"))})
    log_rows(made, "public", "nation").write.parquet(f"file://{tmp_path}/log")
    assert main(["run", str(config)], spark) == 0 and said() == [{"config": "shop", "fault": None}]
    assert main(["status", str(config), "--position", "7"], spark) == 0 and said()[0] == {"acked": 7, "caught_up": True, "behind": 0, "rejects": 0}
    assert main(["reconcile", str(config), "--delete"], spark) == 0 and said() == [{"table": "nation", "scanned": 21, "orphaned": 1}]
    assert main(["reload", str(config), "--table", "nation", "--where", "n_nationkey < 3", "--version", "9"], spark) == 0
    assert main(["reload", str(config), "--table", "none"], spark) == 1 and "no view" in said()[0]["fault"]
    assert main(["reindex", str(config), "--table", "nation", "--alias", "nations-now"], spark) == 0 and said()[0]["verdict"] == "exact"
    assert main(["alias", str(config), "--alias", "old", "--index", "nations"], spark) == 0
    assert main(["metrics", str(config)], spark) == 0 and said()[0]["operations"] >= 3
    config.write_text(config.read_text() + 'poll_column = "n_nationkey"\n')
    config.write_text(config.read_text().replace(f"{tmp_path}/views", f"{tmp_path}/polled").replace("[store]", "page = 7\n[store]"))
    assert main(["poll", str(config)], spark) == 0 and said() == [{"pages": 3}]
    assert main(["poll", str(config)], spark) == 0 and said() == [{"pages": 0}]
    assert main(["metrics", str(config), "--stream", "poll-public.nation"], spark) == 0
    counted = said()[0]
    assert (counted["batches"], counted["upserts"]) == (3, 20)
    config.write_text(config.read_text().replace("polled", "views").replace("page = 7\n", "").replace('poll_column = "n_nationkey"\n', ""))
    assert main(["load", str(config)], spark) == 0 and main(["rejects", str(config), "--retry"], spark) == 0 and said()[-1] == {"total": 0}


SKIPPED = {"stream_equals_batch"}  # its own test below


@pytest.mark.parametrize("name", sorted(set(queries.SQL) - SKIPPED))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted((tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in rows), key=repr)
    assert plain(tuple(r[c] for c in columns) for r in got.collect()) == plain(tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall())


def test_stream_equals_batch(spark):
    one = queries.QUERIES["stream_equals_batch"](spark, DATA)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, queries.QUERIES["lww_merge"](spark, DATA).collect()))


def test_entry_works_without_the_llm_folder(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
