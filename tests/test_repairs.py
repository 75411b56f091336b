"""Repairs, guards, feed limits and small rules on literal tables."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import hmac
import html

from pyspark.sql import functions as F

from bazaarlens import schema
from bazaarlens.functions import contact
from bazaarlens.functions.contact import age_days
from bazaarlens.functions.parse import with_parsed
from bazaarlens.operators import ingest, maintenance, resolve, search
from bazaarlens.sources import feeds, sinks

DAY = lambda k: dt.datetime(2026, 9, k)
PAGE = '{"products":[{"id":%d,"title":"iPhone 15 128GB","handle":"h","vendor":"Apple","product_type":"Mobile","body_html":"x","images":[{"src":"a","w":1},{"src":"b"}],"variants":[{"id":%d,"sku":"S%d","price":"5.000","available":true,"title":"Default Title","grams":3}]}]}'


def pages(spark, rows):
    return spark.createDataFrame([(s, "all", p, "https://shop.example/products.json", c, t, "application/json") for s, p, c, t in rows], schema.LANDED)


def test_why_a_read_stops(spark):
    rows = [("ok", 1, 200, PAGE % (1, 1, 1)), ("ok", 2, 200, '{"products":[]}'), ("gone", 1, 404, ""), ("unread", 1, 599, ""), ("html", 1, 200, "<html>"), ("list", 1, 200, "[1]"), ("object", 1, 200, '{"a":1}'), ("open", 1, 200, PAGE % (1, 1, 1)),
            ("large", 1, 200, '{"products":[' + " " * feeds.MAX_BYTES + "]}")]
    found = {r["store"]: r["reason"] for r in feeds.completeness(feeds.stop_reason(pages(spark, rows), schema.SHOPIFY)).collect()}
    assert found == {"ok": None, "gone": "all: HTTP 404", "unread": "all: not recorded", "html": "all: not valid JSON", "list": "all: no product list", "object": "all: no product list", "open": "all: no empty page", "large": f"all: exceeded {feeds.MAX_BYTES} bytes"}
    refused = pages(spark, rows[:2]).withColumn("allowed", F.lit(False))
    assert feeds.completeness(feeds.stop_reason(refused, schema.SHOPIFY)).first()["reason"] == "all: robots.txt disallows it"
    many = pages(spark, [("s", p, 200, PAGE % (p, p, p)) for p in range(1, 5)] + [("s", 5, 200, '{"products":[]}')])
    short = feeds.completeness(feeds.stop_reason(many, schema.SHOPIFY, max_pages=3)).first()
    assert (short["complete"], short["reason"]) == (False, "all: exceeded 3 pages")
    whole = feeds.completeness(feeds.stop_reason(many, schema.SHOPIFY))
    assert feeds.limited(feeds.shopify(many), whole, most=4).first()["complete"]
    over = feeds.limited(feeds.shopify(many), whole, most=3).first()
    assert (over["complete"], over["reason"]) == (False, "more than 3 kept listings")


def test_slim_pages_read_the_same(spark):
    rows = pages(spark, [("s", 1, 200, PAGE % (1, 1, 1)), ("s", 2, 503, "busy"), ("s", 3, 200, '{"products":[]}')])
    slim = feeds.slimmed(rows)
    assert "body_html" not in slim.filter("page = 1").first()["text"] and slim.filter("page = 2").first()["text"] == "busy"
    assert feeds.shopify(slim).collect() == feeds.shopify(rows).collect()
    assert feeds.completeness(feeds.stop_reason(slim, schema.SHOPIFY)).collect() == feeds.completeness(feeds.stop_reason(rows, schema.SHOPIFY)).collect()
    assert sinks.replay_lines(slim).count() == 3


def test_hosts_and_handles(spark):
    shops = feeds.registry(spark, [("a", "WWW.Shop.example", "shopify"), ("b", "other.example", "woocommerce")])
    assert sorted(r[0] for r in feeds.allowed_hosts(shops).collect()) == ["other.example", "shop.example", "www.other.example", "www.shop.example"]
    handles = ["iphone-15", "آيفون", "a..b", "a/b", "a?b", "a b", "%41", "", "x" * 256, None]
    got = [r[0] for r in spark.createDataFrame([(h,) for h in handles], "h string").select(maintenance.safe_handle(F.col("h"))).collect()]
    assert got == [True, True] + [False] * 8


def test_entities_unescaped_in_arabic_names(spark):
    df = spark.createDataFrame([("شاشة &#8211; 27 &amp; more",), ("plain",), (None,)], "n string")
    assert [r[0] for r in df.select(feeds.unescaped(F.col("n"))).collect()] == ["شاشة – 27 & more", "plain", None]


def test_unparsed_products_go_unless_something_refers_to_them(spark):
    products = spark.createDataFrame([(1, "iPhone 15 128GB", "phones"), (2, "toaster", "phones"), (3, "kettle", None), (4, "lamp", "phones")], "id long, canonical_name string, match_category string")
    reparsed = with_parsed(products, "canonical_name", "c")
    wishes = spark.createDataFrame([(3,)], "product_id long")
    assert sorted(r["id"] for r in maintenance.pruned(products, reparsed, wishes).collect()) == [1, 3]
    assert [tuple(r) for r in maintenance.prune_report(reparsed).collect()] == [("phones", 2), ("-", 1)]


def test_changes_apply_only_to_what_was_audited(spark):
    listings = spark.createDataFrame([(1, "u1", None), (2, "new", None), (3, "u3", DAY(1))], "alias_id long, url string, delisted_at timestamp")
    changes = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "alias_id long, url string")
    assert {r["alias_id"]: r["applied"] for r in maintenance.guarded(changes, listings).collect()} == {1: True, 2: False, 3: False}


def test_removed_account_and_products(spark):
    users, wishes = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 7), (2, 7)], "user_id long, product_id long")
    stores = spark.createDataFrame([(5, 1, 1), (6, 1, 2)], "id long, is_active int, owner_user_id long")
    mail = spark.createDataFrame([(9, 1)], "id long, user_id long")
    out = maintenance.account_removed(1, users=users, wishlist_items=wishes, stores=stores, support_messages=mail)
    assert [r["id"] for r in out["users"].collect()] == [2] and out["wishlist_items"].count() == 1 and out["support_messages"].first()["user_id"] is None
    assert {r["id"]: (r["is_active"], r["owner_user_id"]) for r in out["stores"].collect()} == {5: (0, None), 6: (1, 2)}
    gone = maintenance.product_removed(spark.createDataFrame([(7,)], "id long"), wishlist_items=wishes, contact_events=wishes, products=spark.createDataFrame([(7,), (8,)], "id long"))
    assert gone["wishlist_items"].count() == 0 and {r["product_id"] for r in gone["contact_events"].collect()} == {None} and [r["id"] for r in gone["products"].collect()] == [8]


def test_tokens(spark):
    rows = [(1, 1, "verify", DAY(1), None, DAY(20)), (2, 1, "verify", DAY(3), None, DAY(20)), (3, 2, "verify", DAY(3), DAY(4), DAY(20)), (4, 3, "reset", DAY(1), None, DAY(2))]
    tokens = spark.createDataFrame(rows, "id long, user_id long, purpose string, created_at timestamp, consumed_at timestamp, expires_at timestamp")
    got = {r["id"]: (r["usable"], r["purge"]) for r in maintenance.token_state(tokens, F.lit(dt.datetime(2026, 10, 10))).collect()}
    assert got == {1: (False, False), 2: (False, False), 3: (False, False), 4: (False, True)}
    assert [r["id"] for r in maintenance.token_state(tokens, F.lit(DAY(5))).filter("usable").collect()] == [2]


def test_listing_key_and_age(spark):
    row = spark.range(1).select(resolve.listing_key(F.lit("used"), F.lit("iphone 15")).alias("k"), age_days(F.lit(DAY(1)), F.lit(dt.datetime(2026, 9, 4, 23))).alias("d")).first()
    assert row["k"] == "merchant:used:" + hashlib.sha1(b"iphone 15").hexdigest()[:16] and row["d"] == 3


def test_text_forms(spark):
    texts = ["a b+c/é", "<x & 'y'>", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        contact.path_unquoted(contact.path_quoted(F.col("t"))).alias("same"), contact.pseudonym(F.col("t"), b"key").alias("short"), contact.pseudonym(F.col("t"), b"k" * 80).alias("long"), contact.html_escaped(F.col("t")).alias("html"))
    for t, r in zip(texts, df.collect()):
        assert (r["same"], r["html"]) == (t, html.escape(t))
        assert (r["short"], r["long"]) == tuple(hmac.new(k, t.encode(), "sha256").hexdigest() for k in (b"key", b"k" * 80))
    row = spark.range(1).select(contact.compact_stamp(F.lit(dt.datetime(2026, 9, 4, 23, 5))).alias("s"), contact.stored_attributes(F.lit('{"brand":"apple"}')).alias("m")).first()
    assert row["s"] == "20260904T230500Z" and row["m"] == {"brand": "apple"}


def test_owner_edits_leave_history(spark):
    d = decimal.Decimal
    before = spark.createDataFrame([(1, d("5.000"), True, d("0.000"), DAY(1), DAY(1)), (2, d("6.000"), True, d("0.000"), DAY(1), DAY(1))], "alias_id long, price decimal(10,3), availability boolean, delivery_cost decimal(10,3), last_updated timestamp, checked_at timestamp")
    edits = spark.createDataFrame([(1, d("4.000"), True, d("0.000"))], "alias_id long, price decimal(10,3), availability boolean, delivery_cost decimal(10,3)")
    snapshot, history = ingest.price_edit(edits, before, F.lit(DAY(9)))
    assert {r["alias_id"]: r["price"] for r in snapshot.collect()} == {1: d("4.000"), 2: d("6.000")}
    assert [(r["alias_id"], r["price"]) for r in history.collect()] == [(1, d("5.000"))]


def test_ingest_is_idempotent_and_defines_products_once(spark):
    d = decimal.Decimal
    row = lambda store, sku, name, price: (store, sku, name, f"https://s/{sku}", "", "Mobile", f"i{sku}", "new", d(price), True, d("0.000"))
    feed = spark.createDataFrame([row(1, "A", "iPhone 15 128GB Black", "900"), row(1, "B", "iPhone 15 128GB Black", "890"), row(2, "C", "Apple iPhone 15 128GB Black", "905"), row(2, "D", "Galaxy S24 256GB", "700")],
                                 "store_id long, store_product_id string, name string, url string, brand string, category string, image_url string, condition string, price decimal(10,3), availability boolean, delivery_cost decimal(10,3)")
    aliases = spark.createDataFrame([], "alias_id long, product_id long, store_id long, store_product_id string, store_product_name string, store_product_url string, condition string")
    products = with_parsed(spark.createDataFrame([], "id long, canonical_name string, brand string, category string, image_url string"), "canonical_name", "parsed")
    prices = spark.createDataFrame([], "alias_id long, price decimal(10,3), availability boolean, delivery_cost decimal(10,3), last_updated timestamp, checked_at timestamp")
    run = ingest.ingest(feed, aliases, products, prices, F.lit(DAY(2)), 100, 10)
    assert run.products.count() == 2 and run.aliases.count() == 3 and run.prices.count() == 3 and run.history.count() == 0
    by_store = {(r["store_id"], r["store_product_id"]): r["product_id"] for r in run.landed.collect()}
    assert by_store[1, "A"] == by_store[1, "B"] == by_store[2, "C"] != by_store[2, "D"]
    again = ingest.ingest(feed, run.aliases.drop("match_confidence", "match_method"), run.products, run.prices, F.lit(DAY(3)), 200, 20)
    assert again.products.count() == 2 and again.aliases.count() == 3 and again.history.count() == 0
    assert {r["match_method"] for r in again.landed.collect()} == {"sku", "name"}
    dearer = ingest.ingest(feed.withColumn("price", (F.col("price") + 1).cast("decimal(10,3)")), run.aliases.drop("match_confidence", "match_method"), run.products, run.prices, F.lit(DAY(3)), 200, 20)
    assert dearer.history.count() == 3 and {r["store_id"]: r["price_changes"] for r in dearer.counters.collect()} == {1: 1, 2: 2}
    empty = ingest.ingest(feed.limit(0), run.aliases.drop("match_confidence", "match_method"), run.products, run.prices, F.lit(DAY(3)), 200, 20)
    assert empty.aliases.count() == 3 and empty.landed.count() == 0


def test_searches_without_any_query(spark):
    catalogue = with_parsed(spark.createDataFrame([(1, "iPhone 15 128GB", "apple")], "product_id long, canonical_name string, brand string"), "canonical_name", "c")
    assert search.answered(spark.createDataFrame([], "query_id int, q_text string"), catalogue).count() == 0
