"""What large tables need of plans: keys meet once, rows stay in many tasks."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from bazaarlens import schema
from bazaarlens.functions.parse import with_parsed
from bazaarlens.operators import ingest, maintenance
from bazaarlens.plans.queries import QUERIES
from bazaarlens.sources import feeds
from bazaarlens.sources.entities import Entities


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_listings_of_a_product_meet_it_once(spark):
    products = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    listings = spark.createDataFrame([(1,)] * 50 + [(3,), (None,)], "product_id long")
    left = maintenance.orphans(products, listings)
    assert [r["id"] for r in left.collect()] == [2]
    assert "Aggregate [id" in plan(left)


def test_orphans_need_no_window(spark, sf):
    assert "Window" not in plan(QUERIES["orphan_products"].run(Entities(spark, sf)))


def test_a_request_is_one_row_however_many_rules(spark):
    rules = spark.createDataFrame([("a", False, "/x"), ("a", True, "/x/y$"), ("a", False, "/*?"), ("a", True, "")], "host string, allow boolean, pattern string")
    asked = spark.createDataFrame([("a", "/x"), ("a", "/x"), ("a", "/x/y"), ("a", "/z?q"), ("a", None), ("b", "/x"), (None, "/x")], "host string, path string")
    found = feeds.robots_allows(rules, asked)
    assert sorted(map(str, found.collect())) == sorted(f"Row(host={h!r}, path={p!r}, allowed={a})" for h, p, a in [("a", "/x", False), ("a", "/x/y", True), ("a", "/z?q", False), ("a", None, True), ("b", "/x", True), (None, "/x", True)])
    # Joined after the requests are told apart, and dealt to a fixed number of tasks.
    lines = plan(found).splitlines()
    assert next(i for i, x in enumerate(lines) if "Join LeftOuter" in x) < next(i for i, x in enumerate(lines) if "Aggregate [host" in x) < next(i for i, x in enumerate(lines) if "RepartitionByExpression [host" in x)


def test_an_answer_is_read_once(spark):
    pages = spark.createDataFrame([("s", "all", 1, "https://a.example/p", 200, '{"products":[]}'), ("s", "all", 2, "https://a.example/p", 200, "busy"), ("s", "all", 3, "https://a.example/p", 503, None)], schema.LANDED.rsplit(",", 1)[0])
    told = feeds.stop_reason(pages, schema.SHOPIFY)
    assert [r["problem"] for r in told.orderBy("page").collect()] == [None, "not valid JSON", "HTTP 503"]
    assert plan(feeds.shopify(pages)).count("from_json") == 1
    assert plan(feeds.shopify(feeds.slimmed(pages))).count("from_json") == 2


def test_a_replay_reads_and_moves_answers_once(spark):
    one, none = '{"products":[{"id":1}]}', '{"products":[]}'
    pages = spark.createDataFrame([("end", 1, 200, one), ("end", 2, 200, none), ("end", 3, 200, one), ("gap", 1, 200, one), ("gap", 3, 200, one), ("late", 2, 200, one), ("open", 1, 200, one), ("bad", 1, 503, "x"), ("bad", 1, 504, "x"), ("bad", 2, 200, one)],
                                  "store string, page int, status_code int, text string").withColumns({"target": F.lit("all"), "url": F.lit("u")})
    found = feeds.replayed(pages, schema.SHOPIFY)
    assert sorted((r["store"], r["page"], r["status_code"], r["url"]) for r in found.collect()) == [
        ("bad", 1, 503, "u"), ("end", 1, 200, "u"), ("end", 2, 200, "u"), ("gap", 1, 200, "u"), ("gap", 2, 599, None), ("late", 1, 599, None), ("open", 1, 200, "u"), ("open", 2, 599, None)]
    assert {r["page"] for r in feeds.replayed(pages, schema.SHOPIFY, 1).collect()} == {1} and "Join" not in plan(found)


def test_titles_are_parsed_once_however_many_list_them(spark):
    rows = [(k, "iPhone 15 128GB", None) for k in range(30)] + [(30, "iPhone 15 128GB", "Laptop Sleeves"), (31, "toaster", None), (32, None, "Smart Phones"), (33, "iPhone 15 128GB", "Smart Phones")]
    found = feeds.relevant(spark.createDataFrame(rows, "id int, name string, category string"))
    assert sorted(r["id"] for r in found.collect()) == [*range(30), 33] and {r["parsed"]["category"] for r in found.collect()} == {"phones"}
    above = plan(found).split("Aggregate [")
    assert "regexp" in above[0] and "regexp" not in above[-1].split("\n", 1)[1]


def test_an_audit_reads_links_and_answers_once(spark):
    listed = spark.createDataFrame([(1, 1, "https://a.example/products/x", "k"), (2, 1, "https://a.example/products/y", None), (3, 1, "ftp://a.example/products/x", None)], "alias_id long, store_id long, url string, store_product_id string")
    answers = spark.createDataFrame([(1, "https://a.example/products/x", 200, '{"handle":"x","variants":[{"id":1,"sku":"k"}]}'), (1, "https://a.example/products/y", 200, '{"handle":"z","variants":[]}')], "store_id long, url string, status_code int, text string")
    found = maintenance.audited(listed, answers, ("a.example",))
    assert {r["alias_id"]: r["verdict"] for r in found.collect()} == {1: "OK", 2: "RENAMED", 3: "UNKNOWN"}
    assert plan(found).count("from_json") == 1 and plan(found).count("regexp_extract(") == 1


def test_rows_of_a_run_move_once(spark):
    columns = "store_id long, store_product_id string, name string, url string, brand string, category string, image_url string, condition string, price decimal(10,3), availability boolean, delivery_cost decimal(10,3)"
    row = lambda sku, name, price: (1, sku, name, f"u-{sku}", None, None, None, None, Decimal(price), True, Decimal(0))
    feed = spark.createDataFrame([row("k", "iPhone 15 128GB", 5), row("a", "iPhone 15 128GB", 6), row("b", "iPhone 15 128GB", 7), row("c", "old name", 8)], columns)
    aliases = spark.createDataFrame([(7, 70, 1, "k", "another", "u", "new"), (8, 80, 1, None, "old name", "u", None)], "alias_id long, product_id long, store_id long, store_product_id string, store_product_name string, store_product_url string, condition string")
    products = with_parsed(spark.createDataFrame([(70, "iPhone 15 128GB", None, "phones", None)], "id long, canonical_name string, brand string, category string, image_url string"), "canonical_name")
    told = plan(ingest.landed_on(feed, aliases, products)).split("RepartitionByExpression")
    assert len(told) == 2 and "Join" not in told[0]  # dealt once, and nothing is joined to wide rows after that
    prices = spark.createDataFrame([(7, Decimal(4), True, Decimal(0), None, None)], "alias_id long, price decimal(10,3), availability boolean, delivery_cost decimal(10,3), last_updated timestamp, checked_at timestamp")
    run = ingest.ingest(feed, aliases, products, prices, F.lit("2024-01-01").cast("timestamp"), 100, 1000)
    assert sorted((r["store_product_id"], r["alias_id"], r["product_id"], r["match_method"]) for r in run.landed.collect()) == [("a", 100, 70, "identity"), ("b", 100, 70, "identity"), ("c", 8, 80, "name"), ("k", 7, 70, "sku")]
    assert sorted((r["alias_id"], int(r["price"])) for r in run.prices.collect()) == [(7, 5), (8, 8), (100, 7)]
    assert [(r["alias_id"], r["store_product_id"]) for r in run.aliases.orderBy("alias_id").collect()] == [(7, "k"), (8, None), (100, "a")]


def test_views_start_from_what_is_held(spark, sf):
    e = Entities(spark, sf)
    held = e.holding("feed")
    assert "lineitem" in str(e.landed.inputFiles()) and "lineitem" not in str(held.landed.inputFiles())
    assert "RepartitionByExpression [l_partkey" in plan(e.feed)
