"""Stored tables: merges that touch their buckets only, commits over several tables, concurrent writers."""

import pytest
from pyspark.sql import functions as F

from quillmere.operators import merge
from quillmere.store import Conflict, Layout, Store

LAYOUTS = {
    "items": Layout("k long, v string, at long", ("k",), ("k",), 8),
    "parts": Layout("p string, k long", ("p",), ("k",), 4),
}
ITEM = "k long, v string, at long"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/base", LAYOUTS)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def test_a_merge_rewrites_its_buckets_only(spark, store):
    assert store.begin().append("items", items(spark, *((i, f"v{i}", 0) for i in range(400)))).commit() == 1
    before = store.snapshot()
    change = store.begin().merge("items", items(spark, (7, "late", 5), (7, "later", 9), (1000, "new", 1)), deleted=items(spark, (8, None, None)).select("k"), sequence="at")
    assert change.commit() == 2
    after = store.snapshot()
    touched = set(LAYOUTS["items"].bucket_of(spark, [(7,), (8,), (1000,)]))
    assert 0 < len(touched) < 8
    files = lambda s: {tuple(x) for x in s.tables["items"]}
    assert {b for b, _ in files(before) - files(after)} == {b for b, _ in files(after) - files(before)} == touched
    want = {i: f"v{i}" for i in range(400) if i != 8} | {7: "later", 1000: "new"}
    assert {r.k: r.v for r in after.read("items").collect()} == want and after.read("items").count() == 400
    assert before.read("items").where("k = 7").first().v == "v7"  # an older version stays readable
    few = LAYOUTS["items"].bucket_of(spark, [(7,)])
    assert {r[0] for r in after.read("items", few).select(LAYOUTS["items"].bucket()).distinct().collect()} == set(few)


def test_insert_only_keeps_what_is_there(spark, store):
    store.begin().append("items", items(spark, (1, "a", 0), (None, "null", 0))).commit()
    store.begin().merge("items", items(spark, (1, "b", 1), (2, "c", 2), (2, "d", 1), (None, "other", 1)), sequence="at", insert_only=True).commit()
    assert rows_of(store.read("items")) == rows_of(items(spark, (1, "a", 0), (2, "d", 1), (None, "null", 0)))
    store.begin().merge("items", items(spark, (None, "other", 1)), sequence="at").commit()
    assert rows_of(store.read("items").where("k is null")) == [(None, "other", 1)]
    store.begin().merge("items", deleted=items(spark, (None, "", 0)).select("k")).commit()
    assert store.read("items").count() == 2


def test_tables_are_committed_together(spark, store):
    part = lambda *rows: spark.createDataFrame(list(rows), "p string, k long")
    change = store.begin().append("items", items(spark, (1, "a", 0))).append("parts", part(("x", 1), ("y", 1)))
    assert store.read("parts").count() == store.read("items").count() == 0
    change.add_facts(parts=2).commit(note="first")
    store.begin().merge("items", deleted=items(spark, (1, "", 0)).select("k")).merge("parts", deleted=part(("", 1)).select("k")).add_facts(parts=-2).commit()
    first, last = store.snapshot(1), store.snapshot()
    assert (first.read("items").count(), first.read("parts").count()) == (1, 2)
    assert (last.read("items").count(), last.read("parts").count()) == (0, 0)
    assert first.facts == {"parts": 2, "note": "first"} and last.facts == {"parts": 0, "note": "first"}


def test_two_writers(spark, store):
    store.begin().append("items", items(spark, *((i, "old", 0) for i in range(50)))).commit()
    other = next(k for k in range(50) if LAYOUTS["items"].bucket_of(spark, [(k,)]) != LAYOUTS["items"].bucket_of(spark, [(0,)]))
    one, two, three, four = (store.begin() for _ in range(4))
    one.merge("items", items(spark, (0, "one", 1))).add_facts(n=1)
    two.merge("items", items(spark, (0, "two", 1)))
    three.merge("items", items(spark, (other, "three", 1))).add_facts(n=5)
    four.append("items", items(spark, (99, "four", 1)))
    assert one.commit() == 2
    with pytest.raises(Conflict):
        two.commit()
    assert three.commit() == 3 and four.commit() == 4  # other buckets, and files beside: both stay
    values = {r.k: r.v for r in store.read("items").collect()}
    assert values[0] == "one" and values[other] == "three" and values[99] == "four" and len(values) == 51
    assert store.snapshot().facts == {"n": 6}
    late = store.begin()
    late.replace("items", items(spark, (5, "all", 0)))
    store.begin().append("items", items(spark, (100, "x", 0))).commit()
    with pytest.raises(Conflict):
        late.commit()


def test_vacuum_keeps_what_versions_name(spark, store, tmp_path):
    for n in range(4):
        store.begin().replace("items", items(spark, (n, "v", 0))).commit()
    lost = store.begin()
    lost.append("items", items(spark, (77, "never committed", 0)))
    assert store.vacuum(keep=2) == 0  # all too young
    assert store.vacuum(keep=2, older_than=-5) >= 3
    assert store.versions() == [5 + i for i in range(-2, 0)] or store.versions()[-1] == 4
    assert rows_of(store.read("items")) == [(3, "v", 0)] and rows_of(store.snapshot(3).read("items")) == [(2, "v", 0)]
    held = [p for p in (tmp_path / "base" / "data").rglob("*.parquet")]
    assert len(held) == 2


def test_added_columns_are_null(spark, tmp_path):
    Store(spark, f"file://{tmp_path}/b", {"t": Layout("k long", ("k",), ("k",))}).begin().append("t", spark.range(3).toDF("k")).commit()
    wider = Store(spark, f"file://{tmp_path}/b", {"t": Layout("k long, more string", ("k",), ("k",))})
    wider.begin().merge("t", spark.createDataFrame([(1, "x")], "k long, more string")).commit()
    assert rows_of(wider.read("t")) == [(0, None), (1, "x"), (2, None)]


def test_upsert_order_and_null_keys(spark):
    old = items(spark, (1, "stored", 0), (None, "stored", 0))
    new = items(spark, (1, "5", 5), (1, "7", 7), (1, "6", 6), (None, "n", 1), (None, "m", 2), (2, None, None), (2, "x", 1))
    assert rows_of(merge.upsert(old, new, ["k"], "at")) == rows_of(items(spark, (1, "7", 7), (None, "m", 2), (2, "x", 1)))
    assert rows_of(merge.upsert(old, new, ["k"], "at", keep_first=("v",)).select("k", "v").where("k is null or k = 1")) == [(1, "stored"), (None, "stored")]
    assert rows_of(merge.insert_or_ignore(old, new, ["k"], "at").where("k = 2").select(F.coalesce("v", F.lit("-")))) == [("-",)]
    twice = merge.upsert(old, items(spark, (3, "a", 1), (3, "b", 1)), ["k"], "at").where("k = 3")
    assert rows_of(twice) == [(3, "b", 1)]
