"""Price histories and their jumps, contact taps, request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.session import settled

CHANNELS = ("whatsapp", "call", "facebook", "instagram")


def anomalies(history: DataFrame, since: Column, order: list[str], percent: int = 50) -> DataFrame:
    """Changes of more than ``percent`` against the reading before, among readings since a
    time.  The predecessor is found before the time filter, as it may lie outside."""
    w = W.partitionBy("alias_id").orderBy("recorded_at", *order)
    out = history.withColumn("previous", F.lag("price").over(w)).filter((F.col("recorded_at") > since) & (F.col("previous") > 0))
    change = (F.abs(F.col("price") - F.col("previous")) / F.col("previous") * 100).cast("double")
    return out.withColumn("change_percent", F.round(change, 3)).filter(change > percent)


def anomaly_report(found: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Anomalies with the names of their products and shops."""
    named = found.join(products.select(F.col("id").alias("product_id"), "canonical_name"), "product_id")
    return named.join(stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name")), "store_id")


def history_series(history: DataFrame, offers: DataFrame) -> DataFrame:
    """History of listings that have a current offer, with the shop."""
    return history.join(offers.select("alias_id", "store_name"), "alias_id")


def history_extents(history: DataFrame) -> DataFrame:
    """Least and largest price of each product's chart."""
    return history.groupBy("product_id").agg(F.min("price").alias("low"), F.max("price").alias("high"), F.count("*").alias("points"))


def chart(history: DataFrame, offers: DataFrame) -> DataFrame:
    """``history_extents`` with the least total in stock of each group of offers, where there is one."""
    stocked = lambda group: F.min(F.when(F.col("availability") & (F.col("grp") == group), F.col("total")))
    least = offers.groupBy("product_id").agg(stocked("new").alias("new_from"), stocked("second_hand").alias("second_hand_from"))
    return history_extents(history).join(least, "product_id", "left")


def by_channel(taps: DataFrame, *keys: str) -> DataFrame:
    """Taps per channel, zero where there are none, and their total."""
    counts = [F.count_if(F.col("channel") == c).alias(c) for c in CHANNELS]
    return (taps.groupBy(*keys) if keys else taps.groupBy()).agg(*counts, F.count("*").alias("total"))


def recent(taps: DataFrame, now: Column, days: int) -> DataFrame:
    return taps.filter(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def taps_by_store(stores: DataFrame, taps: DataFrame) -> DataFrame:
    """Every shop with its taps per channel, shops without taps with zeros."""
    names = [*CHANNELS, "total"]
    out = stores.select(F.col("id").alias("store_id")).join(by_channel(taps, "store_id"), "store_id", "left")
    return out.select("store_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def rolling(taps: DataFrame, days: tuple[int, ...] = (1, 7, 30, 365), most: int = 365) -> DataFrame:
    """Taps of each shop that has any in the ``days`` days up to and with each day, from the first day of
    all taps to the last, days without taps too.  A day's taps are counted first, so a window costs
    days and not taps.  A number of days is taken as 1 at least and ``most`` at most."""
    daily = settled(taps.filter("created_at is not null").groupBy("store_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("taps")))
    span = daily.agg(F.min("day").alias("first"), F.max("day").alias("last"))  # one row
    spine = daily.select("store_id").distinct().join(F.broadcast(span)).select("store_id", F.explode(F.sequence("first", "last")).alias("day"))
    every = spine.join(daily, ["store_id", "day"], "left").withColumn("taps", F.coalesce("taps", F.lit(0)))
    upto = W.partitionBy("store_id").orderBy(F.unix_date("day"))
    within = lambda n: F.sum("taps").over(upto.rangeBetween(1 - max(1, min(n, most)), 0)).alias(f"last_{n}")
    return every.select("store_id", "day", *[within(n) for n in days])


def top_products(taps: DataFrame, products: DataFrame, limit: int = 10) -> DataFrame:
    """A shop's products by taps.  Taps without a product do not count here."""
    counts = taps.groupBy("store_id", "product_id").agg(F.count("*").alias("taps")).join(products.select(F.col("id").alias("product_id"), "canonical_name"), "product_id")
    rank = F.row_number().over(W.partitionBy("store_id").orderBy(F.desc("taps"), "product_id"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= limit)


def over_rate(requests: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Fixed windows of ``seconds`` in which a key made more than ``most`` requests."""
    window = F.window(ts, f"{seconds} seconds")
    return requests.groupBy(key, window.alias("w")).agg(F.count("*").alias("requests")).filter(F.col("requests") > most).select(key, F.col("w.start").alias("window_start"), "requests")
