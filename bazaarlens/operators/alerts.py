"""Price alerts and wishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def lowest_new(offers: DataFrame) -> DataFrame:
    return offers.filter("availability and grp = 'new'").groupBy("product_id").agg(F.min("total").alias("lowest"))


def alert_status(alerts: DataFrame, offers: DataFrame) -> DataFrame:
    """Alerts with the least new total, whether the target is met, and the gap to it in percent
    (0 when met, null without an offer)."""
    out = alerts.join(lowest_new(offers), "product_id", "left")
    gap = F.round(((F.col("lowest") - F.col("target_price")) / F.nullif(F.col("target_price"), F.lit(0).cast("decimal(10,3)")) * 100).cast("double"), 0).cast("long")
    return out.withColumn("is_met", F.coalesce(F.col("lowest") <= F.col("target_price"), F.lit(False))).withColumn("gap_percent", F.greatest(gap, F.lit(0)))


def latch(alerts: DataFrame, offers: DataFrame, users: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """One step of all active alerts: ``action`` notify, reset or keep, and the new
    ``notified_at``.  No offer leaves an alert as it is; a price above the target resets one
    that was notified; one at or below it notifies a verified user once.  ``limit`` caps the
    notifications of a run, in id order; the others wait for the next."""
    out = alert_status(alerts.filter("is_active"), offers).join(users.select(F.col("id").alias("user_id"), "is_verified"), "user_id", "left")
    told = F.col("notified_at").isNotNull()
    wanted = F.col("is_met") & ~told & F.coalesce("is_verified", F.lit(False))
    action = F.when(F.col("lowest").isNull(), "keep").when(~F.col("is_met") & told, "reset").when(wanted, "notify").otherwise("keep")
    out = out.withColumn("action", action)
    if limit is not None:
        due = out.filter("action = 'notify'").orderBy("id").limit(limit).select("id", F.lit(True).alias("due"))
        out = out.join(due, "id", "left").withColumn("action", F.when((F.col("action") == "notify") & F.col("due").isNull(), "keep").otherwise(F.col("action"))).drop("due")
    at = F.when(F.col("action") == "notify", now).when(F.col("action") == "reset", F.lit(None).cast("timestamp")).otherwise(F.col("notified_at"))
    return out.select("id", "user_id", "product_id", "lowest", "action", at.alias("notified_at"))


def wishlist_view(wishes: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """Wishes with product names and the least new total, newest first per user."""
    out = wishes.join(products.select(F.col("id").alias("product_id"), "canonical_name"), "product_id").join(lowest_new(offers), "product_id", "left")
    return out.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created_at"), "product_id")))
