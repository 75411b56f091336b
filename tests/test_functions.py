"""Titles, scores and spelling on literal cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from bazaarlens.functions import contact, normalize, score, spelling
from bazaarlens.functions.parse import summary, with_parsed

PARSES = [
    ("iPhone 15 Pro 1TB", "phones", {"storage": "1024gb", "model": "iphone 15"}),
    ("MacBook Pro M3 16GB RAM 512GB SSD", "laptops", {"storage": "512gb", "ram": "16gb", "cpu": "m3"}),
    ("Apple iPhone 11 128GB Black", "phones", {"variant": "base", "color": "black"}),
    ("Redmi Note 15 Pro+ 5G", "phones", {"model": "redmi note 15", "brand": "xiaomi"}),
    ("Xiaomi Redmi Note 15 Pro+ 5G, 12GB & 512GB, 6.8Inch, Black", "phones", {"variant": "pro plus"}),
    ("Redmi Note 15 Pro 5G 128GB Black", "phones", {"variant": "pro"}),
    ("Oppo Smart Phones Reno12 F 4G", "phones", {"model": "reno 12"}),
    ("TECNO SPARK 50", "phones", {"brand": "tecno", "model": "spark 50"}),
    ("Samsung Galaxy Note 20", "phones", {"brand": "samsung", "model": "galaxy note 20"}),
    ("ASUS Vivobook Pro 14 OLED M3401QA AMD RYZEN 5800H", "laptops", {"cpu": "ryzen 5"}),
    ("HP 15-fd2104TU Intel Core Ultra 5 225U 512GB", "laptops", {"cpu": "ultra 5"}),
    ("HP ProBook Intel Core 5-120U 16GB 512GB SSD", "laptops", {"cpu": "core 5"}),
    ("ASUS TUF Gaming A16 AMD Ryzen 7 260 16GB 512GB", "laptops", {"cpu": "ryzen 7"}),
    ('MSI G255F 24.5" FHD 180Hz IPS Monitor', "monitors", {"size": "24 5"}),
    ('ASUS TUF Gaming VG27WQ 27" Curved 2K HDR 165Hz GAMING MONITOR', "monitors", {"size": "27", "resolution": "2k", "refresh": "165"}),
    ("Microsoft Surface Pro 11 (2025) Intel Core Ultra 7 266V 512GB 16GB", "laptops", {"brand": "microsoft", "model": "surface pro"}),
    ("iPhone 13 128GB blue midnight green", "phones", {"color": "midnight green"}),
    ("Samsung 55 inch TV 4K 120Hz", None, {}), ("ThinkPad Laptop Backpack", None, {}),
    ("%%%%", None, {}), ("____", None, {}), ("zzzz", None, {}), ("!!!", None, {}), ("12345", None, {}), ("", None, {}), (None, None, {}),
]


def test_titles(spark):
    df = spark.createDataFrame([(k, t) for k, (t, *_) in enumerate(PARSES)], "k int, title string")
    got = {r["k"]: r["p"] for r in with_parsed(df, "title", "p").collect()}
    for k, (title, category, some) in enumerate(PARSES):
        assert got[k]["category"] == category, title
        assert some.items() <= got[k]["attributes"].items(), title


def test_hints_are_read_by_their_head_noun(spark):
    cases = [
        ("Totu Ring Lenss, Iphone 15, Clear", "Covers & Cases", None), ("Samsung 30L Bespoke Grill Microwave Oven", "Microwave Ovens", None), ("MSI MPG B850I EDGE TI WIFI", "Motherboard", None),
        ("Samsung A26 8GB 256GB - Black", "Mobile", "phones"), ('Dell SE2725HM Flat Monitor 27" FHD IPS @100HZ', "Monitor", "monitors"),
        ("Hp Intel I7 -8550U, 16GB DDR4 & 512GB SSD, 15.6Inch", "Notebook", "laptops"), ("iPhone 15 128GB", "Uncategorized", "phones"), ("iPhone 17 256GB", "iPhone 17", "phones"),
    ]
    df = spark.createDataFrame([(k, t, h) for k, (t, h, _) in enumerate(cases)], "k int, title string, hint string")
    got = {r["k"]: r["p"]["category"] for r in with_parsed(df, "title", "p", hint=F.col("hint")).collect()}
    assert [got[k] for k in range(len(cases))] == [c for *_, c in cases]


def test_arabic_titles_and_prefixes(spark):
    cases = [("ايفون ١٥ ١٢٨ جيجا اسود", "iphone 15 128 gb black"), ("الأيفون ۱۵", "iphone 15"), ("شاشة ٢٧ بوصة 2k ١٨٠ هرتز", "monitor 27 inch 2k 180 hz"), ("لابتوب ماك بوك اير", "laptop macbook air"), ("أَسْوَد", "black"), ("ايفونات", "ايفونات")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    got = {r["k"]: r["n"] for r in df.select("k", normalize.normalize(F.col("t")).alias("n")).collect()}
    assert [got[k] for k in range(len(cases))] == [n for _, n in cases]
    df = spark.createDataFrame([("ايفو",), ("iphon",), ("ج",)], "t string")
    assert [r[0] for r in df.select(normalize.expand_prefix(F.col("t"))).collect()] == ["iphone", "iphon", "ج"]


SCORES = [
    ("Apple iPhone 11 Pro 128GB Black", 100, "exact"), ("iPhone 11 Pro Black 128GB Smartphone 5G", 100, "exact"), ("Apple iPhone 11 Pro 128GB Midnight Green", 90, "close"),
    ("Apple iPhone 11 Pro 256GB Black", 76, "similar"), ("Apple iPhone 11 Pro Max 128GB Black", 72, "similar"), ("Apple iPhone 12 Pro 128GB Black", 67, "excluded"), ("Samsung Galaxy S24 128GB Black", 0, "excluded"),
]


@pytest.fixture(scope="module")
def matches(spark):
    df = spark.createDataFrame([("iPhone 11 Pro Black 128GB", t) for t, *_ in SCORES] + [("iPhone 11 Pro Black 128GB", "Apple iPhone 11 Pro 128GB")], "q string, t string")
    df = with_parsed(with_parsed(df, "t", "c"), "q", "q_parsed", evidence=False, defaults=False)
    return {r["t"]: r for r in df.select("t", score.score_match(F.col("q_parsed"), F.col("c")).alias("m")).withColumn("d", score.differences(F.col("m"))).withColumn("text", F.transform("d", score.describe)).collect()}


def test_scores_and_differences(matches):
    for title, points, tier in SCORES:
        assert (matches[title]["m"]["score"], matches[title]["m"]["tier"]) == (points, tier)
    gate = matches["Samsung Galaxy S24 128GB Black"]["m"]["comparisons"]
    assert [(c["name"], c["query_value"], c["candidate_value"]) for c in gate] == [("brand", "apple", "samsung")]
    missing = matches["Apple iPhone 11 Pro 128GB"]
    assert [(d["name"], d["candidate_value"]) for d in missing["d"]] == [("color", None)] and missing["text"] == ["colour not stated"]
    assert matches["Apple iPhone 11 Pro 256GB Black"]["text"] == ["storage 256gb instead of 128gb"]


def test_identity_and_summary(spark):
    df = spark.createDataFrame([("Apple iPhone 15 128GB Black",), ("iPhone 15 128GB Midnight",), ("iPhone 15 256GB Black",), ("zzz",)], "t string")
    rows = with_parsed(df, "t", "p").select(score.identity(F.col("p")).alias("i"), summary(F.col("p.attributes")).alias("s")).collect()
    assert rows[0]["i"] == rows[1]["i"] != rows[2]["i"] and rows[3]["i"] is None
    assert rows[0]["s"] == "iphone 15 · 128gb · black"


def test_spelling(spark):
    cases = {
        "smasung": "samsung", "xiomi": "xiaomi", "iphon": "iphone", "macbok": "macbook", "samsung": "samsung", "black": "black", "a16": "a16", "s24": "s24", "128gb": "128gb", "lg": "lg",
        "air": "air", "playstation": "playstation", "refrigerator": "refrigerator", "ipone 15 blak": "iphone 15 black", "سمسونج": "سامسونج", "Ipone!": "iphone!", "": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id int, t string")
    got = {r["text"]: (r["corrected"], r["corrections"]) for r in spelling.correct(df, "id", "t").collect()}
    assert {k: v[0] for k, v in got.items()} == cases
    assert got["ipone 15 blak"][1] == {"ipone": "iphone", "blak": "black"} and got["samsung"][1] == {}


def test_contact_details(spark):
    phones = {"+962 79 123 4567": "0791234567", "00962791234567": "0791234567", "962-79-1234567": "0791234567", "079 (123) 4567": "0791234567", "12345": None}
    df = spark.createDataFrame([(p,) for p in phones], "p string")
    assert {r[0]: r[1] for r in df.select("p", contact.local_phone(F.col("p"))).collect()} == phones
    row = spark.range(1).select(contact.money(F.lit("12.345").cast("decimal(10,3)")), contact.path_quoted(F.lit("a b/c")), contact.social_url(F.lit("https://www.facebook.com/shop"), "facebook.com"), contact.social_url(F.lit("http://facebook.com/x"), "facebook.com")).first()
    assert tuple(row)[1:] == ("a%20b%2Fc", "https://www.facebook.com/shop", None) and row[0] in ("12.35 JOD", "12.34 JOD")
