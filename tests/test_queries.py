"""Every registered query with SQL against DuckDB, plan shapes, streams."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import offers
from bazaarlens.plans.queries import QUERIES, current, fresh, runner
from bazaarlens.sources.entities import Entities
from bazaarlens.streaming import taps


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


#: The smallest tables have no such rows; larger ones do.
NONE_THIS_SMALL = {"pending_stores", "orphan_products", "rate_window"}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_equals_sql(spark, duck, sf, name):
    df = runner(QUERIES[name])(spark, sf)
    rel = duck.sql(QUERIES[name].sql)
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(dict(zip(rel.columns, r))[c]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want and (got or name in NONE_THIS_SMALL)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, sf, name):
    assert runner(QUERIES[name])(spark, sf).count() > 0


def test_entry_works_without_the_corpus_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark, sf):
    e = Entities(spark, sf)
    assert "LeftSemi" in plan(offers.with_offer(e.products, current(e)))
    assert "TakeOrderedAndProject" in plan(offers.best_savings(current(e), 10))
    assert "WindowGroupLimit" in plan(offers.cheapest(current(e)))
    from bazaarlens.functions.parse import with_parsed

    assert "EvalPython" not in plan(with_parsed(e.products, "canonical_name"))
    listings = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_shipdate").filter(F.col("l_shipdate") >= fresh())
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual" in plan(listings)


def test_streams(spark, tmp_path):
    rows = [(1, "call", dt.datetime(2024, 1, 1, 10)), (1, "call", dt.datetime(2024, 1, 1, 11)), (2, "call", dt.datetime(2024, 1, 5))]
    schema = "store_id long, channel string, created_at timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = taps.tap_counts(stream).writeStream.outputMode("update").format("memory").queryName("tap_counts").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["store_id"], r["taps"]) for r in spark.table("tap_counts").collect()) == [(1, 2), (2, 1)]
    prices = [(7, 10.0, t, dt.datetime(2024, 1, 1, h)) for h, t in enumerate([12.0, 9.0, 8.0, 11.0, 10.0])]
    schema = "alert_id long, target double, total double, at timestamp"
    spark.createDataFrame(prices, schema).write.parquet(str(tmp_path / "p"))
    q = taps.alert_events(spark.readStream.schema(schema).parquet(str(tmp_path / "p"))).writeStream.outputMode("append").format("memory").queryName("alert_events").option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["event"] for r in spark.table("alert_events").orderBy("at").collect()] == ["notify", "reset", "notify"]
    late = [(7, 10.0, 99.0, dt.datetime(2024, 1, 1, 3)), (7, 10.0, 12.0, dt.datetime(2024, 1, 1, 9))]  # the first is older than what was seen
    spark.createDataFrame(late, schema).write.mode("append").parquet(str(tmp_path / "p"))
    events = []
    q = taps.alert_events(spark.readStream.schema(schema).parquet(str(tmp_path / "p"))).writeStream.outputMode("append").foreachBatch(lambda df, _: events.extend(df.collect())).option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["event"], r["at"].hour) for r in events] == [("reset", 9)]
    seen = []
    taps.each_read(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "e")).awaitTermination(60)
    assert sum(seen) == 3
