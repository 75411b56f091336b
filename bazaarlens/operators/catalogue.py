"""Browsing: ranked products, families of variants, counts, interleaved pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

CATEGORY_ORDER = ("phones", "laptops", "monitors")


def ranked(offers: DataFrame, products: DataFrame) -> DataFrame:
    """Categorised products with new offers in stock: least total and number of shops."""
    figures = offers.filter("availability and grp = 'new'").groupBy("product_id").agg(F.min("total").alias("lowest"), F.countDistinct("store_id").alias("store_count"))
    return products.filter(F.col("match_category").isin(*CATEGORY_ORDER)).withColumnRenamed("id", "product_id").join(figures, "product_id")


def browse_order() -> list[Column]:
    """With a picture first, then cheapest, then by id."""
    return [F.col("image_url").isNull(), F.col("lowest"), F.col("product_id")]


def head_segment(name: Column) -> Column:
    """Name up to the first comma, other than letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.split_part(name, F.lit(","), F.lit(1))), "[^a-z0-9]+", " "))


def family_key(attributes: Column, name: Column) -> Column:
    """What variants in other colours share; the name's head stands in for a missing model."""
    parts = [attributes[k].alias(k) for k in ("brand", "model", "variant", "storage", "ram")]
    segment = F.when(attributes["model"].isNotNull(), "").otherwise(head_segment(name))
    return F.struct(*parts, segment.alias("segment"))


def families(ranked_products: DataFrame, attributes: str = "attributes", name: str = "canonical_name") -> DataFrame:
    """One row per family and category: its first product in browse order, and its size."""
    keyed = ranked_products.withColumn("family", family_key(F.col(attributes), F.col(name)))
    # An aggregate combines before the shuffle; a family's first product is then read by its id.
    first = keyed.groupBy("match_category", "family").agg(F.min_by("product_id", F.struct(*[k.alias(f"k{n}") for n, k in enumerate(browse_order())])).alias("product_id"), F.count("*").alias("variants"))
    return ranked_products.join(first.select("product_id", "variants"), "product_id")


def category_counts(family_rows: DataFrame) -> DataFrame:
    """Families of each category that has any."""
    return family_rows.groupBy("match_category").agg(F.count("*").alias("families"))


def category_ordinal(category: Column) -> Column:
    return F.coalesce(*[F.when(category == c, k) for k, c in enumerate(CATEGORY_ORDER)], F.lit(len(CATEGORY_ORDER)))


def interleaved(family_rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of all categories in turn: first of each, second of each, and so on; with the number
    of all families and whether there are more beyond the page."""
    turn = F.row_number().over(W.partitionBy("match_category").orderBy(*browse_order()))
    turns = family_rows.withColumn("turn", turn).filter(F.col("turn") <= offset + limit)
    page = turns.orderBy("turn", category_ordinal(F.col("match_category"))).offset(offset).limit(limit)
    total = family_rows.agg(F.count("*").alias("total"))  # one row
    return page.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def seeded_shuffle(rows: DataFrame, seed: int, id_col: str = "product_id") -> DataFrame:
    """``place`` within each category: with a picture first, otherwise by a hash of seed,
    category and id; the same seed gives the same order."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "match_category", F.col(id_col).cast("string")))
    # Two-level ranks over ranges of the hash, so no task orders a whole category.
    rows = rows.withColumn("__key", key).withColumn("__part", F.conv(F.substring("__key", 1, 2), 16, 10).cast("int") + F.when(F.col("image_url").isNull(), 256).otherwise(0))
    sizes = rows.groupBy(F.col("match_category").alias("__category"), F.col("__part").alias("__range")).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(W.partitionBy("__category").orderBy("__range")) - F.col("__n")).drop("__n")
    placed = rows.join(before, F.col("match_category").eqNullSafe(F.col("__category")) & (F.col("__part") == F.col("__range")))
    rank = F.row_number().over(W.partitionBy("match_category", "__part").orderBy("__key", id_col))
    return placed.withColumn("place", (F.col("__before") + rank).cast("int")).drop("__key", "__part", "__category", "__range", "__before")
