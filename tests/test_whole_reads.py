"""Reads that arrive page by page are given out as the batch rules see them whole."""

from __future__ import annotations

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from bazaarlens.operators import resolve
from bazaarlens.streaming import taps

SCHEMA = "store string, target string, read_id string, page int, status_code int, text string, at timestamp"
T0 = dt.datetime(2024, 1, 1)
ITEM, EMPTY = json.dumps({"products": [{"id": 1}]}), json.dumps({"products": []})


def page(store, read, number, text, minute, code=200):
    return store, "all", read, number, code, text, T0 + dt.timedelta(minutes=minute)


#: Whole; whole though the empty page comes first; a page missing; a refused page; no empty page; not JSON; a page twice.
READS = {
    ("a", "1"): ([page("a", "1", n, ITEM if n < 4 else EMPTY, n) for n in range(1, 5)], True),
    ("b", "1"): ([page("b", "1", n, ITEM if n < 3 else EMPTY, 9 - n) for n in range(1, 4)], True),
    ("c", "1"): ([page("c", "1", 1, ITEM, 1), page("c", "1", 3, EMPTY, 2)], False),
    ("d", "1"): ([page("d", "1", 1, ITEM, 1), page("d", "1", 2, None, 2, 503), page("d", "1", 3, EMPTY, 3)], False),
    ("e", "1"): ([page("e", "1", 1, ITEM, 1)], False),
    ("f", "1"): ([page("f", "1", 1, ITEM, 1), page("f", "1", 2, "busy", 2)], False),
    ("a", "2"): ([page("a", "2", 1, ITEM, 5), page("a", "2", 1, ITEM, 5), page("a", "2", 2, EMPTY, 6)], True),
}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_pages_gives_the_batch_result(spark, tmp_path, seed):
    rows = [r for own, _ in READS.values() for r in own]
    random.Random(seed).shuffle(rows)
    rows.append(page("later", "9", 1, EMPTY, 600))  # moves the watermark past everybody's patience
    for part in [rows[:5], rows[5:9], rows[9:-1], rows[-1:]]:
        time.sleep(1.1)  # files are read in the order of their times
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = taps.whole_reads(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), "2 hours")
    name = f"whole_reads_{seed}"
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in spark.table(name).collect():
        got.setdefault((r["store"], r["read_id"]), []).append((r["page"], r["status_code"], r["text"], r["complete"]))
    got.pop(("later", "9"))
    want = {k: sorted({(r[3], r[4], r[5], complete) for r in own}) for k, (own, complete) in READS.items()}
    assert {k: sorted(v) for k, v in got.items()} == want
    runs = resolve.run_counters(spark.table(name).select(F.concat("store", "read_id").alias("store_id"), F.lit(False).alias("failed"), "complete"))
    assert {r["store_id"]: r["may_delist"] for r in runs.collect() if r["store_id"] != "later9"} == {a + b: whole for (a, b), (_, whole) in READS.items()}
