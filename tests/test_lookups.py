"""Back-office lookups, backfill and clean-up on literal tables."""

from __future__ import annotations

import datetime as dt


from bazaarlens.functions.parse import with_parsed
from bazaarlens.operators import lookups, maintenance
from bazaarlens.sources import feeds

DAY = lambda k: dt.datetime(2026, 9, k)


def test_messages_and_names(spark):
    support = spark.createDataFrame([(1, 5, False, DAY(1)), (2, None, True, DAY(2)), (3, 6, False, DAY(3))], "id long, user_id long, handled boolean, created_at timestamp")
    users = spark.createDataFrame([(5, "A@x.org", "admin"), (7, "b@x.org", "user")], "id long, email string, role string")
    assert [(r["id"], r["role"]) for r in lookups.messages(support, users).collect()] == [(3, None), (2, None), (1, "admin")]
    assert [r["id"] for r in lookups.messages(support, users, handled=False, limit=1).collect()] == [3]
    assert lookups.unhandled(support).first()[0] == 2 and lookups.by_email(users, "a@X.ORG").first()["id"] == 5
    stores = spark.createDataFrame([(1, "My_Shop"), (2, "MyXShop")], "id long, name string")
    assert [r["id"] for r in lookups.same_name(stores, "my_shop").collect()] == [1]
    ids = spark.createDataFrame([("p", "s", 1), ("p", "t", 2)], "provider string, provider_subject string, user_id long")
    assert lookups.by_identity(ids, "p", "t").first()["user_id"] == 2


def test_sign_ins(spark):
    """Subjects are linked by their first vouched-for address; two of one new address share the account that is made."""
    known = spark.createDataFrame([("p", "s", 1)], "provider string, provider_subject string, user_id long")
    users = spark.createDataFrame([(1, "a@x.org"), (2, "B@x.org"), (3, "b@X.org")], "id long, email string")
    rows = [
        (1, DAY(1), "p", "s", None, False),  # linked before: nothing else is asked
        (2, DAY(1), "p", "t", "b@x.org", False), (3, DAY(2), "p", "t", " B@X.ORG ", True), (4, DAY(3), "p", "t", "other@x.org", False),
        (5, DAY(2), "q", "s", "New@x.org", True), (6, DAY(1), "q", "u", "new@X.org ", True), (7, DAY(1), "q", "u", "else@x.org", True),
        (8, DAY(1), "q", "v", "  ", True), (9, DAY(1), None, "s", "a@x.org", True), (10, DAY(1), "q", None, "a@x.org", True),
    ]
    signs = spark.createDataFrame(rows, "id long, at timestamp, provider string, provider_subject string, email string, email_verified boolean")
    got = {r["id"]: tuple(r)[1:] for r in lookups.signed_in(signs, known, users).collect()}
    assert got == {
        1: ("known", 1, None), 2: ("refused", None, None), 3: ("linked", 2, None), 4: ("known", 2, None), 5: ("linked", None, "new@x.org"), 6: ("created", None, "new@x.org"),
        7: ("known", None, "new@x.org"), 8: ("refused", None, None), 9: ("refused", None, None), 10: ("refused", None, None),
    }
    assert lookups.signed_in(signs.limit(0), known, users).count() == 0
    shops = spark.createDataFrame([(1, "My_Shop"), (2, "my_shop"), (3, None)], "id long, name string")
    applied = spark.createDataFrame([(1, "MY_SHOP"), (2, "myXshop"), (3, "%"), (4, None)], "id long, name string")
    assert [r["id"] for r in lookups.name_clashes(applied, shops).collect()] == [1]


def test_registered_feeds(spark):
    page = '{"products":[{"id":1,"title":"A","handle":"a","vendor":"","product_type":"","images":[],"variants":[{"id":5,"sku":"","price":"3.5","available":true,"title":"x"}]}]}'
    simple = '[{"id":7,"name":"B","type":"simple","sku":"k","is_in_stock":true,"permalink":"u","images":[],"prices":{"price":"1500","currency_code":"JOD","currency_minor_unit":3}}]'
    rows = [("a", "https://www.one.example/p.json", page), ("b", "https://one.example/p.json", page), ("c", "https://three.example/w", simple), ("d", "https://three.example/w", simple), ("e", "https://three.example/w", simple)]
    pages = spark.createDataFrame([(s, "all", 1, url, 200, t, "application/json") for s, url, t in rows], "store string, target string, page int, url string, status_code int, text string, content_type string")
    shops = feeds.registry(spark, [("a", "One.example", "shopify"), ("b", "two.example", "shopify"), ("c", "www.three.example", "woocommerce"), ("d", "three.example", "other")])
    got = feeds.read_registered(pages, shops).collect()
    assert sorted((r["store"], r["feed"], r["store_product_id"], str(r["price"])) for r in got) == [("a", "shopify", "shopify-5", "3.500"), ("c", "woocommerce", "k", "1.500")]
    assert feeds.read_registered(pages, feeds.registry(spark)).count() == 0


def test_photos(spark):
    photos = spark.createDataFrame([(1, 10, DAY(2)), (2, 11, DAY(1)), (3, 20, DAY(1))], "id long, alias_id long, uploaded_at timestamp")
    listings = spark.createDataFrame([(10, 1, 1), (11, 1, 2), (20, 2, 3)], "alias_id long, product_id long, store_id long")
    assert {r["product_id"]: r["id"] for r in lookups.first_photo(photos, listings).collect()} == {1: 2, 2: 3}
    assert [r[0] for r in lookups.with_photos(photos, listings, spark.createDataFrame([(1,), (2,)], "store_id long")).collect()] == [1]
    assert sorted(r["id"] for r in lookups.without_store_photos(photos, listings, 2).collect()) == [1, 3]


def test_backfill_and_cleanup(spark):
    products = with_parsed(spark.createDataFrame([(1, "iphone 15 128gb"), (2, "iPhone 14 128GB"), (3, "toaster")], "id long, canonical_name string"), "canonical_name", "parsed")
    names = spark.createDataFrame([(1, 10, "iPhone 15"), (1, 11, "Apple iPhone 15"), (2, 12, "Longer iPhone 14 128GB")], "product_id long, alias_id long, name string")
    assert {r["id"]: r["canonical_name"] for r in maintenance.backfilled(products, names).collect()} == {1: "Apple iPhone 15", 2: "iPhone 14 128GB"}
    users = spark.createDataFrame([(1, "admin"), (2, "user")], "id long, role string")
    stores = spark.createDataFrame([(7, 2), (8, None)], "id long, owner_user_id long")
    listings = spark.createDataFrame([(7, 100), (7, 101), (8, 101)], "store_id long, product_id long")
    wishes = spark.createDataFrame([(1, 100), (2, 100)], "user_id long, product_id long")
    out = maintenance.cleanup(users, stores, listings, wishes, wishes.limit(0), users.filter("id = 2").select("id"))
    assert [r[0] for r in out["stores"].collect()] == [7] and [r[0] for r in out["products"].collect()] == [100]
    assert out["referring"].first()[0] == 1 and out["refuse"].first()[0] is False
    assert maintenance.cleanup(users, stores, listings, wishes, wishes, users.select("id"))["refuse"].first()[0] is True
