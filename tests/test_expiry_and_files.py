"""Offers that run out, recorded reads, site maps, spelling by shortened words, audits from answers."""

from __future__ import annotations

import datetime as dt
import random
import time
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from bazaarlens import schema
from bazaarlens.functions import spelling
from bazaarlens.operators import maintenance, offers
from bazaarlens.sources import feeds, sinks
from bazaarlens.streaming import taps

T0 = dt.datetime(2024, 1, 1)
HOURS = lambda h: T0 + dt.timedelta(hours=h)


def history(seed):
    rng = random.Random(seed)
    rows = [(1, HOURS(0)), (1, HOURS(48)), (2, HOURS(0)), (2, HOURS(49)), (3, HOURS(5)), (3, HOURS(5)), (4, HOURS(0)), (4, HOURS(200))]
    return rows + [(k, HOURS(rng.randrange(0, 400))) for k in range(5, 25) for _ in range(rng.randrange(1, 7))]


def standing(events, alias, now):
    """Whether the listing's offer counts at ``now`` by its events; one that runs out then still does."""
    up = False
    for _, event, at in sorted((e for e in events if e[0] == alias), key=lambda e: (e[2], e[1] == "gone")):
        if at < now or (at == now and event != "gone"):
            up = event != "gone"
    return up


def test_expiries_are_the_current_offers_of_each_instant(spark):
    rows = history(1)
    readings = spark.createDataFrame(rows, "alias_id long, checked_at timestamp")
    events = [tuple(r) for r in offers.expiries(readings, F.lit(HOURS(1000))).collect()]
    assert len(events) == len(set(events))
    stores = spark.createDataFrame([(1, "s", 1, None, None)], "id long, name string, is_active int, owner_user_id long, is_verified boolean")
    for now in [HOURS(h) for h in (0, 47, 48, 49, 96, 97, 98, 250, 448, 500)]:
        newest = readings.filter(F.col("checked_at") <= F.lit(now)).groupBy("alias_id").agg(F.max("checked_at").alias("checked_at"))
        listed = newest.select("*", F.lit(1).cast("long").alias("store_id"), F.lit(None).cast("timestamp").alias("delisted_at"), F.lit("new").alias("condition"), F.lit(1).cast("decimal(10,3)").alias("price"), F.lit(0).cast("decimal(10,3)").alias("delivery_cost"))
        current = {r["alias_id"] for r in offers.current_offers(listed, stores, F.lit(now - dt.timedelta(hours=48))).collect()}
        assert current == {a for a in {r[0] for r in rows} if standing(events, a, now)}, now
    assert offers.expiries(readings.limit(0), F.lit(T0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_of_readings_gives_the_same_events(spark, tmp_path, seed):
    rows, rng = history(seed), random.Random(seed)
    want = sorted(tuple(r) for r in offers.expiries(spark.createDataFrame(rows, "alias_id long, checked_at timestamp"), F.lit(HOURS(1000))).collect())
    rows = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rng.randrange(0, 30)))  # up to 30 hours out of order
    parts = [rows[k::1][:len(rows) // 4] for k in range(0, len(rows), len(rows) // 4)]
    parts += [[(99, HOURS(1000))], [(99, HOURS(1001))]]  # moves the watermark past every end
    for part in parts:
        spark.createDataFrame(part, "alias_id long, checked_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema("alias_id long, checked_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"offer_events_{seed}"
    query = taps.offer_events(stream, late="31 hours").writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table(name).filter("alias_id <> 99").collect()) == want


ITEM = '{"products":[{"id":1,"title":"iPhone 15","handle":"h","images":[],"variants":[{"id":1,"sku":"S","price":"5","available":true}]}]}'


def test_a_replay_stops_where_nothing_was_recorded(spark, tmp_path):
    end = '{"products":[]}'
    texts = {"whole": {1: ITEM, 2: ITEM, 3: end, 4: ITEM}, "gap": {1: ITEM, 3: end}, "late": {2: ITEM, 3: end}, "open": {1: ITEM}, "odd": {1: ITEM, 2: "[]", 3: end}}
    rows = [(s, "all", p, "https://shop.example/products.json", 200, t, "application/json") for s, own in texts.items() for p, t in own.items()]
    frame = spark.createDataFrame(rows + rows[:1], schema.LANDED)
    sinks.replay_lines(frame).write.option("compression", "gzip").text(str(tmp_path / "rec"))
    asked = feeds.replayed(feeds.landed(spark, str(tmp_path / "rec")), schema.SHOPIFY)
    got = {}
    for r in asked.orderBy("page").collect():
        got.setdefault(r["store"], []).append((r["page"], r["status_code"]))
    assert got == {"whole": [(1, 200), (2, 200), (3, 200)], "gap": [(1, 200), (2, 599)], "late": [(1, 599)], "open": [(1, 200), (2, 599)], "odd": [(1, 200), (2, 200)]}
    told = feeds.completeness(feeds.stop_reason(asked, schema.SHOPIFY)).collect()
    assert {r["store"]: (r["complete"], r["reason"]) for r in told} == {
        "whole": (True, None), "gap": (False, "all: not recorded"), "late": (False, "all: not recorded"), "open": (False, "all: not recorded"), "odd": (False, "all: no product list")}
    assert feeds.replayed(frame.limit(0), schema.SHOPIFY).count() == 0


def test_site_maps_are_whole_files_that_the_index_names(spark, tmp_path):
    rows = spark.range(95).select("id", F.concat(F.lit("<url><loc>https://s/"), "id", F.lit("</loc><lastmod>2024-01-01T00:00:00+00:00</lastmod></url>")).alias("xml"))
    names = sinks.write_sitemaps(rows, "id", str(tmp_path / "m"), "https://s/maps", most=10)
    space, seen = "{http://www.sitemaps.org/schemas/sitemap/0.9}", []
    for name in names:
        root = ET.parse(tmp_path / "m" / "maps" / name).getroot()
        own = [int(u.text.rsplit("/", 1)[1]) for u in root.iter(f"{space}loc")]
        assert root.tag == f"{space}urlset" and 0 < len(own) <= 10 and own == sorted(own)
        seen += own
    assert sorted(seen) == list(range(95))
    (index,) = (tmp_path / "m" / "index").glob("part-*")
    assert [u.text for u in ET.parse(index).getroot().iter(f"{space}loc")] == [f"https://s/maps/{n}" for n in names]
    assert sorted(p.name for p in (tmp_path / "m" / "maps").glob("part-*")) == names
    read = sinks.read_sitemaps(spark, str(tmp_path / "m"))
    assert read.count() == 95 and {r["file"] for r in read.collect()} == set(names)


def test_a_failed_write_names_nothing(spark, tmp_path):
    rows = spark.range(20).select("id", F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise(F.lit("<url></url>")).alias("xml"))
    with pytest.raises(Exception, match="no"):
        sinks.write_sitemaps(rows, "id", str(tmp_path / "m"), "https://s/maps", most=5)
    assert not list(tmp_path.glob("m/maps/part-*")) and not (tmp_path / "m" / "index").exists()
    assert sinks.write_sitemaps(rows.filter("id < 0"), "id", str(tmp_path / "e"), "https://s/maps") == [] and sinks.read_sitemaps(spark, str(tmp_path / "e")).count() == 0


def test_shortened_words_find_what_measuring_all_finds(spark):
    rng, letters = random.Random(5), "abelosunmgx"
    known = spelling.vocabulary()
    typed = set()
    while len(typed) < 300:
        w = list(rng.choice(known))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice([[], [w[k], rng.choice(letters)], [rng.choice(letters)]])
            w = w or ["a"]
        typed.add("".join(w))
    typed |= {"x" * 60, "a", "ab"}
    words = spark.createDataFrame([(w,) for w in typed], "word string")
    pairs = words.crossJoin(spark.createDataFrame([(w,) for w in known], "known string")).withColumn("edits", F.levenshtein("word", "known"))
    want = {}
    for r in pairs.filter(F.col("edits") <= spelling.budget(F.length("word"))).collect():
        want.setdefault(r["word"], []).append((r["edits"], r["known"]))
    clear = {}
    for w, near in want.items():
        nearest = [k for d, k in near if d == min(near)[0]]
        if w not in known and len(nearest) == 1:
            clear[w] = nearest[0]
    assert {r["word"]: r["fixed"] for r in spelling.corrections(words).collect()} == clear and len(clear) > 50


def test_verdicts_come_from_the_answers(spark):
    url = lambda h: f"https://shop.example/products/{h}"
    listed = spark.createDataFrame([(1, 1, url("a"), "S1"), (2, 1, url("a"), "S2"), (3, 1, url("a"), None), (4, 1, url("b"), "S4"), (5, 1, url("c"), "S5"), (6, 1, url("d"), "S6"), (7, 1, "http://elsewhere.example/x", "S7"), (8, 1, url("e"), "shopify-8"), (9, 2, url("a"), "S1")],
                                   "alias_id long, store_id long, url string, store_product_id string")
    body = '{"handle":"%s","variants":[{"id":8,"sku":" %s "}]}'
    answers = spark.createDataFrame([(1, url("a"), 200, body % ("a", "S1")), (1, url("b"), 404, ""), (1, url("c"), 200, body % ("moved", "S5")), (1, url("d"), 200, "<html>"), (1, url("e"), 200, body % ("e", "Z")), (1, "http://elsewhere.example/x", 404, "")],
                                    "store_id long, url string, status_code int, text string")
    got = {r["alias_id"]: r["verdict"] for r in maintenance.audited(listed, answers, ("shop.example",)).collect()}
    assert got == {1: "OK", 2: "VARIANT_GONE", 3: "OK", 4: "GONE", 5: "RENAMED", 6: "UNKNOWN", 7: "UNKNOWN", 8: "OK", 9: "UNKNOWN"}
