"""Feed rows into the catalogue: resolve to products, update prices, delist what is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.functions.score import identity

FLOOR, SHARE = 25, 0.25


def existing_alias(feed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Feed rows with the alias they are: by shop and sku, else by shop, exact name and group;
    of several the smallest."""
    known = aliases.select("store_id", "store_product_id", "store_product_name", F.coalesce("condition", F.lit("new")).alias("condition"), "alias_id", "product_id")
    sku = known.filter("store_product_id is not null").groupBy("store_id", "store_product_id").agg(F.min_by(F.struct("alias_id", "product_id"), "alias_id").alias("by_sku"))
    name = known.groupBy("store_id", F.col("store_product_name").alias("name"), "condition").agg(F.min_by(F.struct("alias_id", "product_id"), "alias_id").alias("by_name"))
    out = feed.withColumn("condition", F.coalesce("condition", F.lit("new"))).join(sku, ["store_id", "store_product_id"], "left").join(name, ["store_id", "name", "condition"], "left")
    out = out.withColumn("found", F.coalesce("by_sku", "by_name"))
    method = F.when(F.col("by_sku").isNotNull(), "sku").when(F.col("by_name").isNotNull(), "name")
    return out.withColumn("alias_id", F.col("found.alias_id")).withColumn("product_id", F.col("found.product_id")).withColumn("match_method", method).drop("by_sku", "by_name", "found")


def by_identity(feed: DataFrame, products: DataFrame, brand_block: bool = False) -> DataFrame:
    """Feed rows (``parsed``) without an alias, with the smallest product of equal identity.
    Two titles answer each other fully exactly if their identities are equal, so the match of
    all against all is an equi-join.  ``brand_block`` also asks for equal stated brands."""
    keys = ["identity", "brand"] if brand_block else ["identity"]
    return feed.withColumn("identity", identity(F.col("parsed"))).join(identities(products, keys), keys, "left")


def identities(products: DataFrame, keys: list[str]) -> DataFrame:
    """The smallest product of each identity."""
    keyed = products.withColumn("identity", identity(F.col("parsed"))).filter("identity is not null")
    return keyed.groupBy(*keys).agg(F.min("id").alias("resolved_product"))


def new_products(unresolved: DataFrame, next_id: int, order: list[str]) -> DataFrame:
    """One product for each identity (or each row without one), named by its first row in
    ``order``: numbered by two-level ranks, so no task orders all rows."""
    key = F.coalesce("identity", F.concat_ws("|", F.lit("row"), *[F.col(c).cast("string") for c in order]))
    rows = unresolved.withColumn("new_key", key).withColumn("rn", F.row_number().over(W.partitionBy("new_key").orderBy(*order))).filter("rn = 1").drop("rn")
    return numbered(rows, ["new_key"], next_id, "id")


def numbered(rows: DataFrame, key: list[str], next_id: int, name: str) -> DataFrame:
    """Rows numbered from ``next_id``, by two-level ranks over hash ranges of their key."""
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(256)))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(W.partitionBy("__part").orderBy(*key))
    return rows.join(before, "__part").withColumn(name, next_id + F.col("__before") + rank - 1).drop("__part", "__before")


def price_changes(now_rows: DataFrame, current: DataFrame, read_at: Column) -> tuple[DataFrame, DataFrame]:
    """New price snapshot, and history rows to append: the price before, where it changed.
    ``checked_at`` always moves for a row that was read, ``last_updated`` only on a change."""
    old = current.select("alias_id", *[F.col(c).alias(f"old_{c}") for c in ("price", "availability", "delivery_cost", "last_updated", "checked_at")])
    both = old.join(now_rows.select("alias_id", "price", "availability", "delivery_cost"), "alias_id", "full")
    seen, had = F.col("price").isNotNull(), F.col("old_price").isNotNull()
    moved = seen & had & (F.col("price") != F.col("old_price"))
    changed = seen & (~had | moved | ~F.col("availability").eqNullSafe(F.col("old_availability")) | ~F.col("delivery_cost").eqNullSafe(F.col("old_delivery_cost")))
    pick = lambda c: F.when(seen, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    snapshot = both.select("alias_id", pick("price"), pick("availability"), pick("delivery_cost"),
                           F.when(changed, read_at).otherwise(F.col("old_last_updated")).alias("last_updated"), F.when(seen, read_at).otherwise(F.col("old_checked_at")).alias("checked_at"))
    history = both.filter(moved).select("alias_id", F.col("old_price").alias("price"), read_at.alias("recorded_at"))
    return snapshot, history


def run_counters(feed: DataFrame) -> DataFrame:
    """Per shop: rows seen, failed, and whether a read may delist: complete, not empty, and no
    more than half failed.  ``feed``: store_id, failed, complete."""
    out = feed.groupBy("store_id").agg(F.count("*").alias("seen"), F.count_if("failed").alias("failed"), F.bool_and("complete").alias("complete"))
    return out.withColumn("may_delist", F.col("complete") & (F.col("seen") > 0) & ~(2 * F.col("failed") > F.col("seen")))


def reconcile(aliases: DataFrame, read: DataFrame, runs: DataFrame, fresh_since: Column, now: Column, floor: int = FLOOR, share: float = SHARE, skus: DataFrame | None = None) -> DataFrame:
    """Aliases of scraped shops with ``action`` (relist, delist, keep) and the new
    ``delisted_at``.  Per shop, more fresh candidates than the floor and the share of showing
    listings are refused: only stale ones go.  ``read``: alias_id of all rows that were read;
    ``skus``: store_id and store_product_id of all rows of the feed, also of those that were not
    taken in: an alias of one of them is there, too."""
    marked = aliases.join(read.select("alias_id", F.lit(True).alias("__here")), "alias_id", "left").join(runs.select("store_id", "may_delist"), "store_id", "left")
    if skus is not None:
        named = skus.select("store_id", "store_product_id").distinct().withColumn("__named", F.lit(True))
        marked = marked.join(named, ["store_id", "store_product_id"], "left").withColumn("__here", F.coalesce("__here", "__named")).drop("__named")
    here, showing = F.coalesce("__here", F.lit(False)), F.col("delisted_at").isNull()
    gone = ~here & showing & F.coalesce("may_delist", F.lit(False))
    marked = marked.withColumn("gone", gone).withColumn("fresh", F.col("checked_at") >= fresh_since)
    valve = marked.groupBy("store_id").agg(F.count_if(F.col("gone") & F.col("fresh")).alias("fresh_gone"), F.count_if(showing).alias("showing"))
    valve = valve.withColumn("refused", F.col("fresh_gone") > F.greatest(F.lit(floor), F.floor(F.col("showing") * share)))
    out = marked.join(valve, "store_id")
    delist = F.col("gone") & ~(F.col("refused") & F.col("fresh"))
    action = F.when(here & ~showing, "relist").when(delist, "delist").otherwise("keep")
    at = F.when(here, F.lit(None).cast("timestamp")).when(delist, F.coalesce("delisted_at", now)).otherwise(F.col("delisted_at"))
    return out.select("alias_id", "store_id", action.alias("action"), at.alias("delisted_at"), "refused")


def outcome(runs: DataFrame) -> DataFrame:
    """Per shop the verdict of a run, in the order that reasons count: ``runs`` has seen,
    failed, complete, refused."""
    why = (F.when(~F.col("complete"), "incomplete").when(F.col("seen") == 0, "empty").when(2 * F.col("failed") > F.col("seen"), "mostly_failed").when(F.col("refused"), "delist_refused").otherwise("ok"))
    return runs.withColumn("verdict", why)


def job_result(outcomes: DataFrame, full: bool) -> DataFrame:
    """One row: the job failed only if every shop did; alerts run only after a clean full run."""
    out = outcomes.agg(F.bool_and(F.col("verdict") != "ok").alias("failed"), F.count_if(F.col("verdict") != "ok").alias("failures"), F.count("*").alias("stores"))
    return out.withColumn("send_alerts", F.lit(full) & (F.col("failures") == 0))


def listing_key(condition: Column, normalized: Column) -> Column:
    """Key of an owner's own listing."""
    return F.concat(F.lit("merchant:"), condition, F.lit(":"), F.substring(F.sha1(normalized), 1, 16))
