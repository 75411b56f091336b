"""Names by letter runs, tiers by what must agree, pages behind cursors."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions.parse import CATEGORIES, with_parsed
from bazaarlens.operators import search, tiers
from bazaarlens.operators.names import containing
from bazaarlens.plans.queries import QUERIES, runner

TITLES = ["Apple iPhone 11 Pro 128GB Black", "Apple iPhone 11 Pro 128GB Midnight Green", "Apple iPhone 11 Pro 256GB Black", "Apple iPhone 12 Pro 128GB Black", "Samsung Galaxy S24 128GB Black", "Dell Inspiron 15 i5 16GB 512GB", "Dell XPS 13 i7 16GB 1TB",
          "LG UltraGear 27 inch 144Hz IPS", "LG 24 inch 75Hz monitor", "Samsung Galaxy S24 Ultra 256GB Gray", "Toaster", "Apple iPhone 11 64GB White", "HP Pavilion laptop i5 8GB 256GB", "Samsung Odyssey G5 27 inch 165Hz QHD"]


def test_terms_find_names_as_a_scan_does(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("abAB 1é%ایف") for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["x", "", "Straße", "STRASSE", None]
    terms = ["a", "AB", "b1", "aBa", "%", "é", "ایف", "ab a", "straße", "zz", "", None, "1é%", "abab", "x", " "]
    terms += [n[2:7] for n in names[:40]]
    got = containing(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "name string"))
    want = {(t, n.lower()) for t in terms if t for n in names if n is not None and t.lower() in n.lower()}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


@pytest.mark.parametrize("rarest", [1, 4])
def test_any_number_of_runs_is_whole(spark, rarest):
    got = containing(spark.createDataFrame([("ana",), ("banana s",)], "term string"), spark.createDataFrame([("Banana Split",), ("nan",), ("ananas",)], "name string"), rarest)
    assert sorted(map(tuple, got.collect())) == [("ana", "ananas"), ("ana", "banana split"), ("banana s", "banana split")]


@pytest.mark.parametrize("name", ["search_answers", "search_page", "suggest", "type_ahead"])
def test_no_nested_loop(spark, sf, name):
    plan = runner(QUERIES[name])(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_forgiven_sets_are_the_largest_within_the_limit():
    assert tiers.forgiven({"a": 10, "b": 20, "c": 33}) == [("a", "b")]
    assert tiers.forgiven({"a": 10, "b": 28, "c": 24}) == [("a",), ("b",), ("c",)]
    assert tiers.forgiven({"c": 33}) == [()]
    assert all(sum(a.weight for a in c.attributes if not a.gate) > tiers.ALLOWED for c in CATEGORIES)


def parsed_pairs(spark):
    rows = [(i, t) for i, t in enumerate(TITLES * 40)]
    shop = with_parsed(spark.createDataFrame(rows, "product_id long, canonical_name string"), "canonical_name", "c").withColumn("lowest_total", (F.col("product_id") * 7) % 90)
    asked = spark.createDataFrame(list(enumerate([*TITLES, "iphone", "galaxy 128gb", "LG monitor 27", "dell", "i5 laptop", "black", "iPhone 15 Pro", "", "nokia 3310"])), "query_id long, t string")
    return with_parsed(asked, "t", "q", evidence=False, defaults=False), shop


def test_tiers_by_what_must_agree_equal_all_pairs(spark):
    asked, shop = parsed_pairs(spark)
    columns = ["query_id", "product_id", "tier", "score", F.to_json("differences").alias("d")]
    got, want = (sorted(map(tuple, df.select(*columns).collect())) for df in (search.tiered(asked, shop), search.scored(search.candidates(asked, shop))))
    assert got == want and {r[2] for r in got} == {"exact", "close", "similar"}
    full = asked.filter(F.col("query_id") < len(TITLES))
    assert 0 < tiers.near(full, shop).count() < 0.5 * search.candidates(full, shop).count()


@pytest.mark.parametrize("sort", ["price_asc", "price_desc", "name", "relevance"])
def test_pages_by_cursor_equal_pages_by_offset(spark, sort):
    asked, shop = parsed_pairs(spark)
    found = search.tiered(asked.filter("query_id in (0, 14, 16)"), shop).withColumn("lowest_total", F.when(F.col("product_id") % 3 > 0, F.col("lowest_total"))).checkpoint()
    seen = None
    for page in range(4):
        rows = search.after(found, seen, sort, 7)
        whole = search.tier_page(found, sort, 7 * page, 7 * page + 7)
        key = ["query_id", "tier", "product_id"]
        assert sorted(map(tuple, rows.select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
        seen = search.cursors_of(rows, seen).checkpoint()


def test_pages_rank_no_more_than_they_show(spark):
    asked, shop = parsed_pairs(spark)
    found = search.tiered(asked, shop).checkpoint()
    for page in (search.tier_page(found, "name", 2, 8), search.after(found, None)):
        assert "WindowGroupLimit" in page._jdf.queryExecution().executedPlan().toString()
