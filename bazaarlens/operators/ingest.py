"""One ingest run: the listings of shops' reads folded into the catalogue.

A listing is, in this order, an alias that is there (by sku, else by name), a new alias of a product
that it fully answers, or the definition of a new product.  Rows of one shop that share a name and
condition, and none of whose skus is known, are one alias: the first in sku order defines it.  Of
rows that land on one alias the last in sku order gives the price.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.functions.parse import with_parsed
from bazaarlens.functions.score import identity
from bazaarlens.operators import resolve
from bazaarlens.session import dealt, written

#: What a read is known by and tells of a listing; ``category`` is the shop's own label.
FEED = ("store_id", "store_product_id", "name", "url", "brand", "category", "image_url", "condition", "price", "availability", "delivery_cost")


#: Rows of one shop that share these, and none of whose skus is known, are one alias.
SAME = ("store_id", "name", "condition")


@dataclass(frozen=True)
class Run:
    """Rows of each table that were there, as they are after the run, and rows that it adds; the history rows to
    append, where each row landed, and counts."""

    kept: dict[str, DataFrame]
    added: dict[str, DataFrame]
    history: DataFrame
    landed: DataFrame
    counters: DataFrame

    def _after(self, name: str) -> DataFrame:
        return self.kept[name].unionByName(self.added[name], allowMissingColumns=True)

    products = property(lambda self: self._after("products"))
    aliases = property(lambda self: self._after("aliases"))
    prices = property(lambda self: self._after("prices"))


def landed_on(feed: DataFrame, aliases: DataFrame, products: DataFrame) -> DataFrame:
    """Feed rows with ``ingest_brand``, ``match_method`` (sku, name, identity or canonical), and alias_id and product_id
    where these are there already; ``parsed`` (parsed here unless the feed brings it) and ``identity`` only of rows that
    no product answers.  Rows without an alias are ``free``; of those that share ``SAME`` the first ``defines`` their
    new alias, the ``__nth`` of its ``__part``, and has its ``definer``'s say on the product; the ``last`` tells its price.

    Rows move once, by a hash of what makes them one alias.  What is known of aliases comes to them there: by name as it
    is, by sku with the name of the row that it is found for.  All that follows are windows in one order."""
    rows = feed.select(*FEED, "parsed") if "parsed" in feed.columns else with_parsed(feed.select(*FEED), "name", "parsed", hint=F.col("category"))
    rows = rows.withColumn("condition", F.coalesce("condition", F.lit("new")))
    known = aliases.select("store_id", "store_product_id", F.col("store_product_name").alias("name"), F.coalesce("condition", F.lit("new")).alias("condition"), F.struct("alias_id", "product_id").alias("known"))
    sku = known.filter("store_product_id is not null").groupBy("store_id", "store_product_id").agg(F.min("known").alias("by_sku"))
    told = rows.select(*SAME, "store_product_id").join(sku, ["store_id", "store_product_id"]).unionByName(known.filter("store_id is not null and name is not null").select(*SAME, F.col("known").alias("by_name")), allowMissingColumns=True)

    rows = rows.withColumn("ingest_brand", F.coalesce(F.nullif(F.lower("brand"), F.lit("")), F.col("parsed.attributes")["brand"])).withColumn("identity", identity(F.col("parsed")))
    rows = rows.join(written(resolve.identities(products.select("id", "parsed"), ["identity"])), "identity", "left")
    rows = rows.withColumns({c: F.when(F.col("resolved_product").isNull(), F.col(c)) for c in ("parsed", "identity")})

    parts = 16 * int(feed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.withColumn("__row", F.lit(True)).unionByName(told.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    both = dealt(both.withColumn("__part", F.pmod(F.xxhash64(*SAME), F.lit(parts))), "__part")
    group = W.partitionBy("__part", *SAME)
    found = both.withColumn("by_sku", F.min("by_sku").over(W.partitionBy("__part", *SAME, "store_product_id"))).withColumn("by_name", F.min("by_name").over(group)).filter("__row")
    method = F.when(F.col("by_sku").isNotNull(), "sku").when(F.col("by_name").isNotNull(), "name").when(F.col("resolved_product").isNotNull(), "identity").otherwise("canonical")
    found = found.withColumn("match_method", method).withColumn("found", F.coalesce("by_sku", "by_name")).withColumn("alias_id", F.col("found.alias_id")).withColumn("product_id", F.coalesce("found.product_id", "resolved_product"))
    found = found.withColumn("free", F.col("alias_id").isNull()).drop("by_sku", "by_name", "found", "resolved_product", "__row")

    so_far, one = group.orderBy("store_product_id").rowsBetween(W.unboundedPreceding, W.currentRow), F.col("free").cast("int")
    definer = F.first(F.when(F.col("free"), F.struct("product_id", "identity", "store_product_id")), ignorenulls=True).over(so_far)
    found = found.withColumn("__free", F.sum(one).over(so_far)).withColumn("__frees", F.sum(one).over(group)).withColumn("__definer", definer)
    found = found.withColumns({"defines": F.col("free") & (F.col("__free") == 1), "last": F.col("free") & (F.col("__free") == F.col("__frees")), "definer": F.when(F.col("product_id").isNull(), F.col("__definer"))})
    nth = F.sum(F.col("defines").cast("int")).over(W.partitionBy("__part").orderBy(*SAME, "store_product_id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return found.withColumn("__nth", nth).drop("__free", "__frees", "__definer")


def ingest(feed: DataFrame, aliases: DataFrame, products: DataFrame, prices: DataFrame, read_at: Column, next_alias: int, next_product: int) -> Run:
    """``aliases``: alias_id, product_id, store_id, store_product_id, store_product_name,
    store_product_url, condition; ``products``: id, canonical_name, brand, category, image_url,
    ``parsed``; ``prices``: alias_id, price, availability, delivery_cost, last_updated, checked_at."""
    rows = written(landed_on(feed, aliases, products))  # parsed once; everything below starts from it
    made = written(resolve.new_products(rows.filter("defines and match_method = 'canonical'"), next_product, ["store_id", "store_product_id"]))
    # A new product's listings: those of its identity, or the one row that has none.
    by_key = made.filter("identity is not null").select(F.col("identity").alias("__identity"), F.col("id").alias("by_identity"))
    by_row = made.filter("identity is null").select(F.col("store_id").alias("__store"), F.col("store_product_id").alias("__sku"), F.col("id").alias("by_row"))
    defined = made.select("id", F.col("name").alias("canonical_name"), F.coalesce("ingest_brand", F.lit("Unknown")).alias("brand"), F.coalesce("category", F.lit("Uncategorized")).alias("category"), "image_url", "parsed")

    # New aliases are numbered part by part; the parts are a few for each shuffle partition.
    sizes = rows.groupBy("__part").agg(F.count_if("defines").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    numbered = rows.join(F.broadcast(before), "__part").withColumn("alias_id", F.coalesce("alias_id", next_alias + F.col("__before") + F.col("__nth") - 1)).drop("__part", "__before", "__nth")
    missing = numbered.filter("product_id is null").join(by_key, F.col("definer.identity") == F.col("__identity"), "left").join(by_row, (F.col("store_id") == F.col("__store")) & (F.col("definer.store_product_id").eqNullSafe(F.col("__sku"))) & F.col("definer.identity").isNull(), "left")
    missing = missing.withColumn("product_id", F.coalesce("definer.product_id", "by_identity", "by_row")).select(*numbered.columns)
    landed = numbered.filter("product_id is not null").unionByName(missing).drop("definer")

    new_aliases = landed.filter("defines").select("alias_id", "product_id", "store_id", "store_product_id", F.col("name").alias("store_product_name"), F.col("url").alias("store_product_url"), "condition",
                                                  F.when(F.col("match_method") == "canonical", 1.0).otherwise(0.95).alias("match_confidence"), "match_method")
    here = landed.filter("not free")  # on aliases that were there; only they meet what is known of these
    last = lambda c: F.max_by(c, "store_product_id").alias(c)
    told = here.groupBy("alias_id").agg(*[last(c) for c in ("price", "availability", "delivery_cost", "url")])
    # The feed's address wins; a product keeps the first picture that it got.
    kept = aliases.join(told.select("alias_id", "url"), "alias_id", "left").withColumn("store_product_url", F.coalesce("url", "store_product_url")).drop("url")
    fed = written(landed.filter("image_url is not null").groupBy(F.col("product_id").alias("id")).agg(F.min_by("image_url", F.struct("store_id", "store_product_id")).alias("fed")))
    pictured = lambda df: df.join(fed, "id", "left").withColumn("image_url", F.coalesce("image_url", "fed")).drop("fed")
    snapshot, history = resolve.price_changes(told, prices, read_at)
    seen = F.col("price").isNotNull()
    first = landed.filter("last").select("alias_id", *[F.when(seen, F.col(c)).alias(c) for c in ("price", "availability", "delivery_cost")], *[F.when(seen, read_at).alias(c) for c in ("last_updated", "checked_at")])

    changed = here.select("alias_id", "store_id").distinct().join(history.select("alias_id"), "alias_id", "left_semi").groupBy("store_id").agg(F.count("*").alias("price_changes"))
    methods = [F.count_if(F.col("match_method") == m).alias(f"by_{m}") for m in ("sku", "name", "identity", "canonical")]
    counts = landed.groupBy("store_id").agg(F.count("*").alias("seen"), F.count_if(F.col("price").isNull()).alias("failed"), *methods, F.count_if("defines").alias("__new"))
    known = here.groupBy("store_id").agg(F.countDistinct("alias_id").alias("__known"))
    counters = counts.join(known, "store_id", "left").withColumn("aliases", F.col("__new") + F.coalesce("__known", F.lit(0))).drop("__new", "__known")
    counters = counters.join(changed, "store_id", "left").withColumn("price_changes", F.coalesce("price_changes", F.lit(0)))
    return Run({"products": pictured(products.select(*defined.columns)), "aliases": kept, "prices": snapshot}, {"products": pictured(defined), "aliases": new_aliases, "prices": first}, history, landed.drop("free", "defines", "last"), counters)


def run_result(counters: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Counters of each shop's run with what reconciling changed and whether it was refused."""
    out = reconciled.groupBy("store_id").agg(F.count_if(F.col("action") == "delist").alias("delisted"), F.count_if(F.col("action") == "relist").alias("relisted"), F.bool_or("refused").alias("refused"))
    return counters.join(out, "store_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("delisted", "relisted")}).withColumn("refused", F.coalesce("refused", F.lit(False)))


def price_edit(edits: DataFrame, prices: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """An owner's price edits leave the same history as a read does."""
    return resolve.price_changes(edits, prices, now)
