"""Runs committed to tables: repeated, killed at any step, and read back."""

from __future__ import annotations

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions.parse import with_parsed
from bazaarlens.operators import activity, ingest
from bazaarlens.sources import committed
from bazaarlens.streaming import taps

D, T0 = decimal.Decimal, dt.datetime(2024, 1, 1)
FEED = "store_id int, store_product_id string, name string, url string, brand string, category string, image_url string, condition string, price decimal(18,3), availability boolean, delivery_cost decimal(18,3)"
ALIASES = "alias_id long, product_id long, store_id int, store_product_id string, store_product_name string, store_product_url string, condition string, match_confidence double, match_method string"


def feed(spark, prices):
    return spark.createDataFrame([(1, sku, name, f"https://s/{sku}", None, None, None, "new", D(price), True, D(0)) for sku, name, price in prices], FEED)


@pytest.fixture
def store(spark, tmp_path):
    out = committed.CommittedCatalogue(spark, f"file://{tmp_path}/c", parts=4)
    products = with_parsed(spark.createDataFrame([(1, "Apple iPhone 11 Pro 128GB Black", "apple", "phones", None), (2, "Toaster", "x", "y", None)], "id long, canonical_name string, brand string, category string, image_url string"), "canonical_name", "parsed")
    aliases = spark.createDataFrame([(10, 1, 1, "A", "Apple iPhone 11 Pro 128GB Black", "old", "new", None, None), (11, 2, 1, "B", "Toaster", "old", "new", None, None)], ALIASES)
    prices = spark.createDataFrame([(a, D(p), True, D(0), T0, T0) for a, p in ((10, 100), (11, 20))], "alias_id long, price decimal(18,3), availability boolean, delivery_cost decimal(18,3), last_updated timestamp, checked_at timestamp")
    out.start(products=products, aliases=aliases, prices=prices)
    return out


def run_of(store, rows, at, first=1000):
    return lambda: ingest.ingest(rows, store.read("aliases"), store.read("products"), store.read("prices"), F.lit(at), first, first)


def state(store):
    drop = lambda df: sorted(map(str, df.withColumn("x", F.lit(0)).collect()))
    return [drop(store.read(n)) for n in committed.KEYS], drop(store.history())


FIRST = [("A", "Apple iPhone 11 Pro 128GB Black", 90), ("N", "Samsung Galaxy S24 128GB Black", 50)]


def test_a_run_is_committed_once(spark, store):
    rows, at = feed(spark, FIRST), dt.datetime(2024, 2, 1)
    assert store.history().count() == 0
    assert store.commit("r1", run_of(store, rows, at))
    once = state(store)
    assert not store.commit("r1", run_of(store, rows, at)) and state(store) == once
    prices = {r["alias_id"]: (r["price"], r["checked_at"]) for r in store.read("prices").collect()}
    assert prices == {10: (D(90), at), 11: (D(20), T0), 1000: (D(50), at)}
    assert [(r["alias_id"], r["price"], r["run_id"]) for r in store.history().collect()] == [(10, D(100), "r1")]
    assert {r["alias_id"]: (r["match_method"], r["match_confidence"]) for r in store.read("aliases").collect()}[1000] == ("canonical", 1.0)
    assert store.commit("r2", run_of(store, feed(spark, [("A", "Apple iPhone 11 Pro 128GB Black", 95)]), dt.datetime(2024, 3, 1), 2000))
    assert sorted((r["price"], r["run_id"]) for r in store.history().collect()) == [(D(90), "r2"), (D(100), "r1")]


@pytest.mark.parametrize("step", ["write-history", "seal", "apply-1", "apply-2", "mark"])
def test_a_killed_run_is_repeated_whole(spark, store, monkeypatch, tmp_path, step):
    rows, at = feed(spark, FIRST), dt.datetime(2024, 2, 1)
    calls = {"n": 0}

    class Killed(Exception):
        pass

    mark, apply, write = store._mark, store._apply, store._write

    def broken_mark(run_id, name):
        if (step, name) in (("seal", committed.SEALED), ("mark", committed.APPLIED)):
            raise Killed
        mark(run_id, name)

    def broken_apply(run_id):
        if step.startswith("apply"):
            keys = list(committed.KEYS.items())[: int(step[-1])]
            monkeypatch.setattr(committed, "KEYS", dict(keys))
            monkeypatch.setattr(store, "_mark", lambda *_: None)
            apply(run_id)
            raise Killed
        apply(run_id)

    def broken_write(run_id, run):
        write(run_id, run)
        if step == "write-history":
            raise Killed

    with monkeypatch.context() as m:
        for name, f in (("_mark", broken_mark), ("_apply", broken_apply), ("_write", broken_write)):
            m.setattr(store, name, f)
        with pytest.raises(Killed):
            store.commit("r1", run_of(store, rows, at))
    monkeypatch.undo()
    calls["n"] = store.history().count()
    assert calls["n"] == (0 if step in ("write-history", "seal") else 1)
    store.commit("r1", run_of(store, rows, at))
    prices = {r["alias_id"]: r["price"] for r in store.read("prices").collect()}
    assert prices == {10: D(90), 11: D(20), 1000: D(50)} and store.read("aliases").count() == 3 and store.read("products").count() == 3
    assert [(r["alias_id"], r["price"]) for r in store.history().collect()] == [(10, D(100))]


def test_only_touched_partitions_are_replaced(spark, store, tmp_path):
    store.commit("r1", run_of(store, feed(spark, [("A", "Apple iPhone 11 Pro 128GB Black", 90)]), dt.datetime(2024, 2, 1)))
    before = {r[0] for r in store.spark.read.parquet(f"{store.root}/prices").select("_metadata.file_path").distinct().collect()}
    store.commit("r2", run_of(store, feed(spark, [("A", "Apple iPhone 11 Pro 128GB Black", 80)]), dt.datetime(2024, 3, 1)))
    after = {r[0] for r in store.spark.read.parquet(f"{store.root}/prices").select("_metadata.file_path").distinct().collect()}
    assert len(before & after) == len(before) - 1 and len(after) == len(before)


def test_rolling_windows_count_days_without_taps(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 23)), (1, dt.datetime(2024, 1, 1, 5)), (1, dt.datetime(2024, 1, 4, 1)), (2, dt.datetime(2024, 1, 8)), (3, None)]
    events = spark.createDataFrame(rows, "store_id int, created_at timestamp")
    got = {(r["store_id"], r["day"].day): tuple(r)[2:] for r in activity.rolling(events, (0, 3, 7, 999)).collect()}
    assert len(got) == 16 and got[1, 1] == (2, 2, 2, 2) and got[1, 3] == (0, 2, 2, 2) and got[1, 4] == (1, 1, 3, 3) and got[1, 8] == (0, 0, 1, 3) and got[2, 7] == (0, 0, 0, 0) and got[2, 8] == (1, 1, 1, 1)
    assert activity.rolling(events.limit(0)).count() == 0
    events.filter("created_at is not null").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = taps.rolling(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), 3)
    query = stream.writeStream.format("memory").queryName("rolling_taps_stream").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination()
    windows = {(r["store_id"], r["day"].day): r["taps"] for r in spark.table("rolling_taps_stream").collect()}
    assert all(windows.get((s, d), 0) == n[1] for (s, d), n in got.items()) and windows[2, 10] == 1
