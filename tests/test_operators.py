"""Offers, browsing, ingest, alerts, audits and feeds on small literal tables."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.functions.parse import with_parsed
from bazaarlens.operators import activity, admin, alerts, catalogue, maintenance, offers, resolve, search
from bazaarlens.sources import feeds, sinks

NOW = dt.datetime(2026, 9, 20, 12)
FRESH = NOW - dt.timedelta(hours=48)
ago = lambda **k: NOW - dt.timedelta(**k)


@pytest.fixture(scope="module")
def market(spark):
    """Shops Fresh, Gone, Stale (scraped) and Merchant (verified owner)."""
    stores = spark.createDataFrame(
        [(1, "Fresh", 1, None, False, False), (2, "Gone", 1, None, False, False), (3, "Stale", 1, None, False, False), (4, "Merchant", 1, 9, True, False), (5, "Pending", 1, 8, False, False), (6, "Off", 0, None, False, False)],
        "id long, name string, is_active int, owner_user_id long, is_verified boolean, is_rejected boolean")
    stale = ago(hours=54)
    rows = [(10, 1, 1, 700, ago(hours=1), None), (11, 1, 2, 600, ago(hours=1), NOW), (12, 1, 3, 650, stale, None), (13, 1, 4, 720, ago(days=30), None), (20, 2, 1, 800, ago(hours=1), None), (21, 2, 2, 900, ago(hours=1), NOW),
            (30, 3, 1, 750, ago(hours=1), None), (31, 3, 3, 950, stale, None), (40, 4, 2, 500, ago(hours=1), NOW), (50, 5, 3, 450, stale, None), (60, 6, 4, 200, ago(days=30), None), (70, 7, 5, 1, NOW, None), (71, 7, 6, 1, NOW, None)]
    listings = spark.createDataFrame([(a, p, s, D(x), D("0.000"), True, "new", seen, gone) for a, p, s, x, seen, gone in rows],
                                     "alias_id long, product_id long, store_id long, price decimal(10,3), delivery_cost decimal(10,3), availability boolean, condition string, checked_at timestamp, delisted_at timestamp")
    return listings, stores, offers.current_offers(listings, stores, F.lit(FRESH))


def test_current_offers_and_summaries(market):
    _, _, current = market
    assert {r["alias_id"] for r in current.collect()} == {10, 13, 20, 30, 60}
    phone = {r["product_id"]: r for r in offers.price_summary(current).collect()}[1]
    assert (phone["store_count"], phone["best_store"], phone["lowest_total"], phone["highest_price"]) == (2, "Fresh", D(700), D(720))
    deals = offers.best_savings(current).collect()
    assert [(r["product_id"], r["saving"], r["store_count"], r["saving_percent"]) for r in deals] == [(1, D(20), 2, 2.8)]
    cards = {r["product_id"]: r for r in offers.search_cards(current).collect()}
    assert cards[6]["lowest_total"] == D(200) and cards[6]["second_hand_from"] is None


def test_used_offers_and_unknown_stock_do_not_lead(spark, market):
    listings, stores, _ = market
    more = spark.createDataFrame([(80, 8, 1, D(800), None, True, None, NOW, None), (81, 8, 4, D(400), D(5), True, "used", NOW, None), (82, 8, 4, D(1), None, None, "new", NOW, None)], listings.schema)
    current = offers.current_offers(more, stores, F.lit(FRESH))
    card = offers.search_cards(current).first()
    assert (card["lowest_total"], card["second_hand_from"], card["store_count"], card["second_hand_stores"]) == (D(800), D(405), 1, 1)
    assert offers.best_savings(current).count() == 0


def test_money_is_exact(spark, market):
    _, stores, _ = market
    rows = [(1, 1, 1, "0.100", "0.200"), (2, 2, 1, "100.001", "0"), (3, 2, 4, "100.002", "0")]
    listings = spark.createDataFrame([(a, p, s, D(x), D(y), True, "new", NOW, None) for a, p, s, x, y in rows], market[0].schema)
    got = {r["product_id"]: r for r in offers.price_summary(offers.current_offers(listings, stores, F.lit(FRESH))).collect()}
    assert got[1]["lowest_total"] == D("0.300") and got[2]["best_store"] == "Fresh"


def test_families_and_interleaving(spark):
    titles = [(1, "Honor X5c 64GB Tidal Blue", "u"), (2, "Honor X5c 64GB Midnight Black", "u"), (3, "VIVO Y02 32GB Orchid Blue", "u"), (4, "VIVO Y02 32GB Cosmic Grey", None), (5, "Infinix Smart 20, 64GB phone", "u"), (6, "Infinix Tab XPAD 30E, 64GB phone", "u"), (7, "Infinix Smart 20, 128GB phone", "u"),
              (8, "LG 27 inch FHD Monitor", "u"), (9, "Dell Inspiron 5400 Laptop i5 512GB", "u")]
    df = spark.createDataFrame(titles, "product_id long, canonical_name string, image_url string")
    df = with_parsed(df, "canonical_name", "c").withColumn("attributes", F.col("c.attributes")).withColumn("match_category", F.col("c.category")).withColumn("lowest", (F.col("product_id") * 10).cast("decimal(10,3)"))
    got = {r["product_id"]: r["variants"] for r in catalogue.families(df).collect()}
    assert got == {1: 2, 3: 2, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1}
    page = [r["product_id"] for r in catalogue.interleaved(catalogue.families(df), 0, 4).collect()]
    assert page == [1, 9, 8, 3]
    once, again = (sorted((r["product_id"], r["place"]) for r in catalogue.seeded_shuffle(df, 3).collect()) for _ in range(2))
    assert once == again and len({p for _, p in once}) >= 6
    assert {r["match_category"]: r["families"] for r in catalogue.category_counts(catalogue.families(df)).collect()} == {"phones": 5, "monitors": 1, "laptops": 1}


def test_anomalies_compare_with_the_reading_before(spark):
    at = lambda k: ago(hours=6) + dt.timedelta(minutes=10 * k)
    series = {1: [900, 400], 2: [900, 880], 3: [900], 4: [900, 800, 700, 620]}
    rows = [(a, D(p), at(k)) for a, ps in series.items() for k, p in enumerate(ps)] + [(5, D(900), ago(days=3)), (5, D(100), ago(hours=1))]
    df = spark.createDataFrame(rows, "alias_id long, price decimal(10,3), recorded_at timestamp")
    got = activity.anomalies(df, F.lit(ago(hours=24)), []).collect()
    assert sorted((r["alias_id"], r["previous"]) for r in got) == [(1, D(900)), (5, D(900))]


def test_taps_are_zero_filled_and_windowed(spark):
    taps = spark.createDataFrame([(1, 1, 5, "call", ago(days=45)), (2, 1, None, "call", ago(days=3))], "id long, store_id long, product_id long, channel string, created_at timestamp")
    stores = spark.createDataFrame([(1,), (999,)], "id long")
    got = {r["store_id"]: r for r in activity.taps_by_store(stores, activity.recent(taps, F.lit(NOW), 30)).collect()}
    assert (got[1]["total"], got[1]["call"], got[1]["whatsapp"], got[999]["total"]) == (1, 1, 0, 0)
    products = spark.createDataFrame([(5, "x")], "id long, canonical_name string")
    assert [(r["product_id"], r["taps"]) for r in activity.top_products(taps, products).collect()] == [(5, 1)]


def test_search_tiers_and_pages(spark):
    titles = ["Apple iPhone 11 Pro 128GB Black", "Apple iPhone 11 Pro 128GB Midnight Green", "Apple iPhone 11 Pro 256GB Black", "Apple iPhone 12 Pro 128GB Black", "Samsung Galaxy S24 128GB Black"]
    shop = with_parsed(spark.createDataFrame(list(enumerate(titles)), "product_id long, canonical_name string"), "canonical_name", "c").withColumn("lowest_total", F.col("product_id") + 100)
    asked = spark.createDataFrame([(1, "iPhone 11 Pro Black 128GB"), (2, "iphone")], "query_id long, t string")
    found = search.scored(search.candidates(with_parsed(asked, "t", "q", evidence=False, defaults=False), shop))
    got = {(r["query_id"], r["product_id"]): r["tier"] for r in found.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {0: "exact", 1: "close", 2: "similar"}
    assert {v for k, v in got.items() if k[0] == 2} == {"similar"} and sum(k[0] == 2 for k in got) == 4
    page = search.tier_page(found, "price_desc", 0, 1).collect()
    assert {(r["query_id"], r["tier"]): (r["product_id"], r["tier_count"]) for r in page}[(2, "similar")] == (3, 4)
    assert [r["canonical_name"] for r in search.by_name(shop, [F.lit("100%")], ["canonical_name"]).collect()] == []


def test_ingest_is_idempotent_and_keeps_history(spark):
    schema = "alias_id long, price decimal(10,3), availability boolean, delivery_cost decimal(10,3), last_updated timestamp, checked_at timestamp"
    before = spark.createDataFrame([(1, D(10), True, D(0), ago(days=2), ago(days=2)), (2, D(20), True, D(0), ago(days=2), ago(days=2)), (3, D(30), True, D(0), ago(days=2), ago(days=2))], schema)
    read = spark.createDataFrame([(1, D(10), True, D(0)), (2, D(25), True, D(0)), (4, D(5), True, D(0))], "alias_id long, price decimal(10,3), availability boolean, delivery_cost decimal(10,3)")
    snapshot, history = resolve.price_changes(read, before, F.lit(NOW))
    got = {r["alias_id"]: r for r in snapshot.collect()}
    assert [(r["alias_id"], r["price"]) for r in history.collect()] == [(2, D(20))]
    assert (got[1]["last_updated"], got[1]["checked_at"], got[2]["last_updated"], got[3]["checked_at"], got[4]["price"]) == (ago(days=2), NOW, NOW, ago(days=2), D(5))
    again, none = resolve.price_changes(read, snapshot, F.lit(NOW))
    assert none.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, snapshot.collect()))


def test_resolution_by_sku_name_and_identity(spark):
    aliases = spark.createDataFrame([(1, 7, 1, "SB-1", "iPhone 15 128GB", "new"), (2, 8, 1, "SB-2", "Other", None)], "alias_id long, product_id long, store_id long, store_product_id string, store_product_name string, condition string")
    feed = spark.createDataFrame([(1, "SB-1", "renamed", "new"), (1, "X", "Other", "new"), (1, "Y", "Nothing", "new"), (2, "SB-1", "x", "new")], "store_id long, store_product_id string, name string, condition string")
    got = {(r["store_id"], r["store_product_id"]): (r["alias_id"], r["match_method"]) for r in resolve.existing_alias(feed, aliases).collect()}
    assert got == {(1, "SB-1"): (1, "sku"), (1, "X"): (2, "name"), (1, "Y"): (None, None), (2, "SB-1"): (None, None)}
    rows = with_parsed(spark.createDataFrame([(0, "Apple iPhone 15 128GB Black"), (1, "iPhone 15 128GB Black"), (2, "Apple MacBook Air M2 256GB"), (3, "Samsung Galaxy S24 128GB"), (4, "zzz"), (5, "zzz")], "listing long, name string"), "name", "parsed")
    products = rows.filter("listing = 2").select(F.lit(50).cast("long").alias("id"), "parsed")
    found = resolve.by_identity(rows, products)
    assert {r["listing"]: r["resolved_product"] for r in found.collect()}[2] == 50
    fresh = resolve.new_products(found.filter("resolved_product is null"), 100, ["listing"]).collect()
    assert len({r["id"] for r in fresh}) == len(fresh) == 4 and min(r["id"] for r in fresh) == 100
    assert resolve.by_identity(rows.withColumn("brand", F.lit("x")), products.withColumn("brand", F.lit("y")), brand_block=True).filter("resolved_product is not null").count() == 0


def test_delisting_and_its_valve(spark):
    schema = "alias_id long, store_id long, delisted_at timestamp, checked_at timestamp"
    aliases = spark.createDataFrame([(k, 1, None, ago(hours=1)) for k in range(4)] + [(9, 1, ago(days=9), ago(hours=1)), (20, 2, None, ago(days=9))], schema)
    runs = spark.createDataFrame([(1, True), (2, False)], "store_id long, may_delist boolean")
    act = lambda ids: {r["alias_id"]: (r["action"], r["refused"]) for r in resolve.reconcile(aliases, spark.createDataFrame([(i,) for i in ids], "alias_id long"), runs, F.lit(FRESH), F.lit(NOW), floor=1).collect()}
    two, three = act([0, 1, 9]), act([0, 1, 2])
    assert two[2] == ("keep", True) and two[9][0] == "relist"
    assert three[3] == ("delist", False) and three[9][0] == "keep" and three[20][0] == "keep"
    feed = spark.createDataFrame([(1, False, True)] * 3 + [(2, True, True)] * 2 + [(3, False, False)], "store_id long, failed boolean, complete boolean")
    verdicts = resolve.outcome(resolve.run_counters(feed).withColumn("refused", F.lit(False)))
    assert {r["store_id"]: (r["verdict"], r["may_delist"]) for r in verdicts.collect()} == {1: ("ok", True), 2: ("mostly_failed", False), 3: ("incomplete", False)}
    job = resolve.job_result(verdicts, full=True).first()
    assert (job["failed"], job["failures"], job["send_alerts"]) == (False, 2, False)


def test_alert_latch(spark, market):
    _, _, current = market
    users = spark.createDataFrame([(1, True), (2, False)], "id long, is_verified boolean")
    step = lambda rows, **k: {r["id"]: r["action"] for r in alerts.latch(spark.createDataFrame([(i, u, p, D(t), True, at) for i, u, p, t, at in rows], "id long, user_id long, product_id long, target_price decimal(10,3), is_active boolean, notified_at timestamp"), current, users, F.lit(NOW), **k).collect()}
    assert step([(1, 1, 1, 700, None), (2, 1, 1, 700, NOW), (3, 1, 1, 600, NOW), (4, 1, 1, 600, None), (5, 2, 1, 900, None), (6, 1, 4, 900, NOW)]) == {1: "notify", 2: "keep", 3: "reset", 4: "keep", 5: "keep", 6: "keep"}
    assert step([(k, 1, 1, 700, None) for k in range(4)], limit=2) == {0: "notify", 1: "notify", 2: "keep", 3: "keep"}


def test_feeds(spark):
    page = lambda items: json.dumps({"products": items})
    product = lambda k, title, variants, kind="Smart Phone": {"id": k, "title": title, "handle": f"h{k}", "vendor": "V", "product_type": kind, "images": [{"src": "i"}], "variants": variants}
    v = lambda k, sku, price, title="Default Title": {"id": k, "sku": sku, "price": price, "available": True, "title": title}
    rows = [
        ("a", "all", 1, "https://a.example/products.json", 200, page([product(1, "Apple iPhone 15 128GB", [v(1, " SB-1 ", "899.000"), v(2, "", "1.5", "Blue")]), product(2, "Phone Case", [v(3, "C", "x")], "Covers"), product(3, "Dup", [v(4, "SB-1", "5")])]), "json"),
        ("a", "all", 2, "https://a.example/products.json", 200, page([]), "json"), ("b", "all", 1, "https://b.example/", 503, "", "html"), ("c", "all", 1, "https://c.example/", 200, "<html>", "html"),
        ("d", "all", 1, "https://d.example/", 200, "[]", "json"), ("e", "all", 1, "https://e.example/", 200, page([product(1, "x", [])]), "json"),
    ]
    pages = spark.createDataFrame(rows, "store string, target string, page int, url string, status_code int, text string, content_type string")
    got = sorted((r["store_product_id"], r["name"], r["price"]) for r in feeds.shopify(pages).collect())
    assert got == [("SB-1", "Apple iPhone 15 128GB", D("899.000")), ("shopify-2", "Apple iPhone 15 128GB Blue", D("1.500"))]
    why = {r["store"]: (r["complete"], r["reason"]) for r in feeds.completeness(feeds.stop_reason(pages, feeds.schema.SHOPIFY)).collect()}
    assert why["a"] == (True, None) and "HTTP 503" in why["b"][1] and "not valid JSON" in why["c"][1] and "no product list" in why["d"][1] and "no empty page" in why["e"][1]
    assert {r["store_product_id"] for r in feeds.relevant(feeds.shopify(pages)).collect()} == {"SB-1", "shopify-2"}
    woo = [{"id": 1, "name": "شاشة &#8211; 27 inch FHD", "type": "simple", "sku": "", "is_in_stock": True, "permalink": "u", "images": [], "prices": {"price": "99900", "currency_code": "JOD", "currency_minor_unit": 2}},
           {"id": 2, "name": "v", "type": "variable", "sku": "k", "is_in_stock": True, "permalink": "u", "images": [], "prices": {"price": "1", "currency_code": "JOD", "currency_minor_unit": 0}}]
    pages = spark.createDataFrame([("w", "m", 1, "https://w.example/", 200, json.dumps(woo), "json")], pages.schema)
    assert [(r["store_product_id"], r["name"], r["price"]) for r in feeds.woocommerce(pages).collect()] == [("woo-1", "شاشة – 27 inch FHD", D("999.000"))]


def test_robots(spark):
    text = "User-agent: bad\nDisallow: /\n\nUser-agent: *\nAllow: /products/$\nDisallow: /products/ # all\nDisallow: /*.json$\nAllow: /products/open\nDisallow:"
    rules = feeds.robots_rules(spark.createDataFrame([("h", text)], "host string, text string"))
    paths = {"/products/": True, "/products/x": False, "/products/open/1": True, "/a.json": False, "/a.json?x": True, "/": True}
    asked = spark.createDataFrame([("h", p) for p in paths], "host string, path string")
    assert {r["path"]: r["allowed"] for r in feeds.robots_allows(rules, asked).collect()} == paths


def test_maintenance(spark, tmp_path):
    products = spark.createDataFrame([(1, "apple iphone 15", "phones", {"a": "1", "b": "2"}), (2, "iPhone 15 Black", "phones", {"b": "2", "a": "1"}), (3, "x", "phones", {"a": "2"}), (4, "y", None, {})], "id long, canonical_name string, match_category string, attributes map<string,string>")
    assert [tuple(r) for r in maintenance.duplicate_groups(products).collect()] == [("phones", 1, 2, "iPhone 15 Black")]
    wishes = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (3, 6, 2), (4, 6, 3)], "id long, user_id long, product_id long")
    moved = maintenance.repointed(wishes, maintenance.survivors(products), ["user_id", "product_id"])
    assert sorted((r["id"], r["product_id"]) for r in moved.collect()) == [(1, 1), (3, 1), (4, 3)]
    assert sorted(r["product_id"] for r in maintenance.prune_guard(products.filter("id > 2"), wishes).collect()) == [3]
    gone = maintenance.product_removed(spark.createDataFrame([(2,)], "id long"), products=products, contact_events=wishes)
    assert gone["products"].count() == 3 and gone["contact_events"].filter("product_id is null").count() == 2
    variants = F.array(F.struct(F.lit(7).alias("id"), F.lit("K1").alias("sku")))
    row = spark.range(1).select(*[maintenance.variant_present(F.lit(k).cast("string"), variants) for k in ("K1", "shopify-7", "no", None)]).first()
    assert tuple(row) == (True, True, False, None)
    sinks.write_json(products, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 4
    jobs = spark.createDataFrame([(1, "queued", "", NOW, None, None), (2, "running", "", NOW, ago(hours=2), None), (3, "queued", "a", ago(days=1), None, None)], "id long, status string, store_codes string, created_at timestamp, started_at timestamp, finished_at timestamp")
    assert {r["id"]: r["status"] for r in admin.one_pending(jobs).collect()} == {1: "failed", 2: "running"}
    assert admin.claimable(jobs, F.lit(NOW)).first()["id"] == 3 and admin.due(jobs, F.lit(NOW), 12).first()["due"] is False


def test_one_pending_run_is_found_without_ordering_all(spark):
    jobs = spark.createDataFrame([(1, "queued", ""), (3, "queued", ""), (2, "done", "")], "id long, status string, store_codes string")
    left = admin.one_pending(jobs)
    assert "Window" not in left._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["status"] for r in left.collect()} == {1: "failed", 3: "queued"}


def test_no_window_over_a_whole_query_or_category(spark):
    rows = spark.range(3000).select(F.col("id").alias("product_id"), F.when(F.col("id") % 7 > 0, "phones").alias("match_category"), F.when(F.col("id") % 3 > 0, "u").alias("image_url"))
    shuffled = catalogue.seeded_shuffle(rows, 3)
    key = F.md5(F.concat_ws(":", F.lit("3"), "match_category", F.col("product_id").cast("string")))
    want = rows.withColumn("place", F.row_number().over(W.partitionBy("match_category").orderBy(F.col("image_url").isNull(), key, "product_id")))
    assert shuffled.columns == want.columns and sorted(map(str, shuffled.collect())) == sorted(map(str, want.collect()))
    ranks = [x for x in shuffled._jdf.queryExecution().optimizedPlan().toString().splitlines() if "row_number()" in x]
    assert ranks and all("__part" in x.split("row_number()")[1] for x in ranks)
    shop = with_parsed(spark.createDataFrame([(1, "Apple iPhone 11 Pro 128GB Black")], "product_id long, canonical_name string"), "canonical_name", "c")
    asked = with_parsed(spark.createDataFrame([(1, "iPhone 11 Pro")], "query_id long, t string"), "t", "q", evidence=False, defaults=False)
    assert "Window" not in search.scored(search.candidates(asked, shop))._jdf.queryExecution().optimizedPlan().toString()
