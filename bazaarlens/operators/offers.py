"""Which offers a shopper may see, and per-product figures over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MONEY = "decimal(11,3)"


def visible(prefix: str = "") -> Column:
    """Shop predicate: active, and scraped or verified."""
    c = lambda n: F.col(f"{prefix}{n}")
    return (c("is_active") == 1) & (c("owner_user_id").isNull() | F.coalesce(c("is_verified"), F.lit(False)))


def current(fresh_since: Column) -> Column:
    """Offer predicate over listing and shop columns: visible shop, not delisted, and read
    since ``fresh_since`` unless the shop's owner keeps it."""
    return visible() & F.col("delisted_at").isNull() & (F.col("owner_user_id").isNotNull() | (F.col("checked_at") >= fresh_since))


def total(price: str = "price", delivery: str = "delivery_cost") -> Column:
    return (F.col(price) + F.coalesce(F.col(delivery), F.lit(0).cast("decimal(10,3)"))).cast(MONEY)


def group_of(condition: Column) -> Column:
    """new, or second_hand for any other stated condition."""
    return F.when(F.coalesce(condition, F.lit("new")) == "new", "new").otherwise("second_hand")


def current_offers(listings: DataFrame, stores: DataFrame, fresh_since: Column) -> DataFrame:
    """Listings with an offer that counts now, with store name, total and comparison group.
    Catalyst broadcasts the shops where their size allows and joins on the key otherwise."""
    shops = stores.select(F.col("id").alias("store_id"), F.col("name").alias("store_name"), "is_active", "owner_user_id", "is_verified")
    out = listings.join(shops, "store_id").filter(current(fresh_since))
    return out.withColumn("total", total()).withColumn("grp", group_of(F.col("condition"))).drop("is_active", "is_verified")


def with_offer(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Products that have any current offer: a semi join."""
    return products.join(offers.select(F.col("product_id").alias("id")), "id", "left_semi")


def expiries(readings: DataFrame, now: Column, keep: str = "INTERVAL 48 HOURS") -> DataFrame:
    """``alias_id, event, at``: when each listing first had an offer (new), when the offer ran out because
    ``keep`` had passed since a reading without another (gone; the offer still counts at that instant), and
    the reading that brought it back (back).  Readings after ``now`` do not count yet."""
    order, at = W.partitionBy("alias_id").orderBy("checked_at"), F.col("checked_at")
    near = readings.filter(at <= now).select("alias_id", "checked_at", F.lag(at).over(order).alias("before"), F.lead(at).over(order).alias("next"))
    ends = at + F.expr(keep)
    out = F.when((F.col("next").isNull() & (ends < now)) | (F.col("next") > ends), F.struct(F.lit("gone").alias("event"), ends.alias("at")))
    up = F.when(F.col("before").isNull(), "new").when(at > F.col("before") + F.expr(keep), "back")
    into = F.when(up.isNotNull(), F.struct(up.alias("event"), at.alias("at")))
    return near.select("alias_id", F.inline(F.array_compact(F.array(into, out))))


def price_summary(offers: DataFrame) -> DataFrame:
    """Per product and group, over offers in stock: price range, least total and where, shops.
    Of shops with the same least total the lowest alias wins."""
    return offers.filter("availability").groupBy("product_id", "grp").agg(
        F.min("price").alias("lowest_price"), F.max("price").alias("highest_price"), F.min("total").alias("lowest_total"),
        F.min_by("store_name", F.struct("total", "alias_id")).alias("best_store"), F.countDistinct("store_id").alias("store_count"),
        F.sort_array(F.collect_list("price")).alias("prices"), F.sort_array(F.collect_list("total")).alias("totals"),  # a value a shop
    )


def search_cards(offers: DataFrame) -> DataFrame:
    """One row per product: figures of new offers, and from what price it is had second-hand."""
    new, used = F.col("grp") == "new", F.col("grp") == "second_hand"
    return offers.filter("availability").groupBy("product_id").agg(
        F.min(F.when(new, F.col("price"))).alias("lowest_price"), F.max(F.when(new, F.col("price"))).alias("highest_price"), F.min(F.when(new, F.col("total"))).alias("lowest_total"),
        F.min_by("store_name", F.when(new, F.struct("total", "alias_id"))).alias("best_store"), F.countDistinct(F.when(new, F.col("store_id"))).alias("store_count"),
        F.min(F.when(used, F.col("total"))).alias("second_hand_from"), F.countDistinct(F.when(used, F.col("store_id"))).alias("second_hand_stores"),
    )


def best_savings(offers: DataFrame, limit: int | None = None) -> DataFrame:
    """New products that two shops or more sell at different totals, by the gap."""
    gaps = offers.filter("availability and grp = 'new'").groupBy("product_id").agg(
        F.min("total").alias("cheapest"), F.max("total").alias("dearest"), F.countDistinct("store_id").alias("store_count"), F.min_by("store_name", F.struct("total", "alias_id")).alias("best_store"))
    gaps = gaps.filter("store_count >= 2 and dearest > cheapest").withColumn("saving", (F.col("dearest") - F.col("cheapest")).cast(MONEY))
    gaps = gaps.withColumn("saving_percent", F.bround((F.col("saving") / F.col("dearest") * 100).cast("double"), 1))
    return gaps.orderBy(F.desc("saving"), "product_id").limit(limit) if limit else gaps


def cheapest(offers: DataFrame) -> DataFrame:
    """The cheapest current offer in stock of each product and group."""
    order = W.partitionBy("product_id", "grp").orderBy("total", "alias_id")
    return offers.filter("availability").withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("product_id", "grp", "alias_id", "store_name", "total")
