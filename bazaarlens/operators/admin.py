"""Shops, listings and queues as an administrator sees them; health and site-map rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators.activity import taps_by_store

STALE_HOURS = 14


def review_status(prefix: str = "") -> Column:
    """scraped, verified, rejected or pending."""
    c = lambda n: F.col(f"{prefix}{n}")
    return F.when(c("owner_user_id").isNull(), "scraped").when(c("is_verified"), "verified").when(c("is_rejected"), "rejected").otherwise("pending")


def pending_stores(stores: DataFrame) -> DataFrame:
    return stores.filter(F.col("owner_user_id").isNotNull() & ~F.col("is_verified") & ~F.col("is_rejected"))


def store_overview(stores: DataFrame, listings: DataFrame, taps: DataFrame) -> DataFrame:
    """Every shop with its listings and taps, zeros where it has none."""
    counts = listings.groupBy("store_id").agg(F.count("*").alias("listings"))
    out = stores.select(F.col("id").alias("store_id"), "name", review_status().alias("status")).join(counts, "store_id", "left")
    return out.join(taps_by_store(stores, taps).select("store_id", F.col("total").alias("taps")), "store_id").withColumn("listings", F.coalesce("listings", F.lit(0)))


def listing_counts(stores: DataFrame, listings: DataFrame) -> DataFrame:
    """Every shop with the number of its listings."""
    counts = listings.groupBy(F.col("store_id").alias("id")).agg(F.count("*").alias("n"))
    return stores.select("id", "name").join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def remaining_admins(users: DataFrame, leaving: DataFrame) -> DataFrame:
    """One row: how many administrators stay when some accounts (column id) go."""
    return users.filter("role = 'admin'").join(leaving.select("id"), "id", "left_anti").agg(F.count("*").alias("admins"))


def admin_listings(aliases: DataFrame, prices: DataFrame, products: DataFrame) -> DataFrame:
    """All listings with their product, and their price where there is one: an outer join."""
    return aliases.join(prices, "alias_id", "left").join(products.select(F.col("id").alias("product_id"), "canonical_name"), "product_id")


def platform_stats(**tables: DataFrame) -> DataFrame:
    """Row count of each table, one row a table."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counts)


def xml_escape(text: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def w3c(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def sitemap_rows(offers: DataFrame, base_url: str, limit: int | None = None) -> DataFrame:
    """Products whose visible offers include one in stock, with the newest change; as XML."""
    out = offers.groupBy("product_id").agg(F.max("checked_at").alias("changed"), F.bool_or(F.coalesce("availability", F.lit(False))).alias("stocked")).filter("stocked").drop("stocked")
    loc = xml_escape(F.concat(F.lit(f"{base_url}/product/"), F.col("product_id")))
    out = out.withColumn("xml", F.concat(F.lit("<url><loc>"), loc, F.lit("</loc><lastmod>"), w3c(F.col("changed")), F.lit("</lastmod></url>")))
    return out.orderBy("product_id").limit(limit) if limit else out


def category_lastmod(offers: DataFrame, products: DataFrame) -> DataFrame:
    new = offers.filter("grp = 'new'").join(products.select(F.col("id").alias("product_id"), "match_category"), "product_id")
    return new.groupBy("match_category").agg(F.max("checked_at").alias("changed"))


def catalogue_health(listings: DataFrame, stores: DataFrame, now: Column, stale_hours: int = STALE_HOURS) -> DataFrame:
    """One row: newest reading of scraped shops, its age in hours, ok or stale."""
    scraped = stores.filter("owner_user_id is null").select(F.col("id").alias("store_id"))
    out = listings.join(scraped, "store_id", "left_semi").agg(F.max("checked_at").alias("newest"))
    age = F.round((F.unix_timestamp(now) - F.unix_timestamp("newest")) / 3600.0, 1).cast("double")
    return out.withColumn("age_hours", age).withColumn("status", F.when(F.col("age_hours") <= stale_hours, "ok").otherwise("stale"))


def one_pending(jobs: DataFrame) -> DataFrame:
    """Of pending full runs one stays, a running one first, else the newest; the rest fail."""
    pending = jobs.filter("store_codes = '' and status in ('queued', 'running')")
    stays = pending.agg(F.max_by("id", F.struct(F.col("status") == "running", F.col("id"))).alias("stays"))
    return pending.join(F.broadcast(stays)).select("id", F.when(F.col("id") == F.col("stays"), F.col("status")).otherwise("failed").alias("status"))


def due(jobs: DataFrame, now: Column, hours: int) -> DataFrame:
    """One row: whether to queue a full run: none pending, the last one long enough ago."""
    full = jobs.filter("store_codes = ''")
    out = full.agg(F.count_if(F.col("status").isin("queued", "running")).alias("pending"), F.max(F.when(F.col("status") == "done", F.col("finished_at"))).alias("last"))
    return out.select(((F.col("pending") == 0) & (F.col("last").isNull() | (F.col("last") <= now - F.make_dt_interval(hours=F.lit(hours))))).alias("due"))


def claimable(jobs: DataFrame, now: Column, stale_minutes: int = 60) -> DataFrame:
    """The oldest job to run: queued, or running for too long."""
    stuck = (F.col("status") == "running") & (F.col("started_at") <= now - F.make_dt_interval(mins=F.lit(stale_minutes)))
    return jobs.filter((F.col("status") == "queued") | stuck).orderBy("created_at", "id").limit(1)
