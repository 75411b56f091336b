"""Shops' product feeds, from landed answers: pages of JSON to listings, and whether a read is
complete.  Landing (requests, retries, politeness) is not Spark's work; a landed answer is a row
of ``schema.LANDED``, for example from gzip JSON lines."""

from __future__ import annotations

import html
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window as W

from bazaarlens import schema
from bazaarlens.functions.parse import with_parsed
from bazaarlens.session import dealt, settled, written

MAX_PAGES, MAX_BYTES, MAX_PRODUCTS = 200, 8 << 20, 20_000


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers; other fields of the lines are not read."""
    return spark.read.schema(schema.LANDED).json(path)


def stop_reason(pages: DataFrame, layout: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """Pages with ``items`` and, where the read cannot go on, ``problem``: a target that robots
    rules refuse (a false ``allowed``, if there is such a column), the answer's status or size,
    unreadable JSON, or the wrong shape."""
    allowed = F.coalesce("allowed", F.lit(True)) if "allowed" in pages.columns else F.lit(True)
    wrong = F.lit("not a list of products") if layout.startswith("array") else F.lit("no product list")
    items = F.from_json("text", layout) if layout.startswith("array") else F.from_json("text", layout)["products"]
    readable = F.coalesce(F.try_parse_json("text").isNotNull(), F.lit(False))
    shape = F.startswith(F.ltrim("text"), F.lit("[" if layout.startswith("array") else "{"))
    unread = (F.when(~allowed, "robots.txt disallows it").when(F.octet_length("text") > MAX_BYTES, f"exceeded {MAX_BYTES} bytes").when(F.col("status_code") == 599, "not recorded").when(F.col("status_code") != 200, F.concat(F.lit("HTTP "), F.col("status_code")))
              .when(~readable, "not valid JSON").when(~shape, wrong))
    found, why = F.col("__read.items"), F.col("__read.unread")
    problem = F.coalesce(why, F.when(found.isNull(), wrong).when(F.col("page") > max_pages, f"exceeded {max_pages} pages"))
    out = _once_read(pages, "__unread", unread)
    out = _once_read(out, "__read", F.struct(F.col("__unread").alias("unread"), F.when(F.col("__unread").isNull(), items).alias("items"))).drop("__unread")
    return out.withColumn("problem", problem).withColumn("items", F.when(F.col("problem").isNull(), found)).drop("__read")


def _once_read(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that is computed once a row: an array of one, exploded, into which no condition on it is
    pushed and which is not repeated where it is referred to."""
    return df.withColumn(name, F.explode(F.array(value)))


def replayed(recorded: DataFrame, layout: str, max_pages: int = MAX_PAGES) -> DataFrame:
    """Recorded answers as a reader gets them that asks page by page: of each shop and target the pages from 1 to
    the first without products, with a problem (``stop_reason``) or not recorded; that one is answered with 599, so
    that its read is incomplete.  Of a page recorded twice the least row counts."""
    rest = [c for c in recorded.columns if c not in ("store", "target", "page")]
    whole, here = W.partitionBy("store", "target"), ["store", "target", "page"]
    # Dealt by shop and target once: all that follows stays where it is.
    known = recorded.filter(F.col("page").between(1, max_pages)).repartition("store", "target").groupBy(*here).agg(F.min(F.struct(*rest)).alias("r")).select(*here, "r.*")
    before = F.coalesce(F.lag("page").over(whole.orderBy("page")), F.lit(0))
    pages = stop_reason(known, layout, max_pages).select(*here, *rest, (F.col("problem").isNotNull() | (F.size("items") == 0)).alias("stops")).withColumn("before", before)
    least = lambda c: F.min(c).over(whole)
    end = F.least(least(F.when(F.col("stops"), F.col("page"))), least(F.when(F.col("page") > F.col("before") + 1, F.col("before") + 1)), F.max("page").over(whole) + 1, F.lit(max_pages))
    ended = pages.withColumn("end", end).withColumn("has_end", F.max(F.col("page") == F.col("end")).over(whole))
    # Pages before the end are all there; if the end is not, the first page that is there brings it along.
    none = F.struct(F.col("end").alias("page"), *[(F.lit(599) if c == "status_code" else F.lit(None)).cast(recorded.schema[c].dataType).alias(c) for c in rest])
    own = F.when(F.col("page") <= F.col("end"), F.array(F.struct("page", *[F.coalesce("status_code", F.lit(599)).alias(c) if c == "status_code" else F.col(c) for c in rest]))).otherwise(F.array())
    out = ended.select("store", "target", F.explode(F.when((F.col("before") == 0) & ~F.col("has_end"), F.concat(own, F.array(none))).otherwise(own)).alias("r"))
    return out.select("store", "target", "r.*").select(*recorded.columns)


def limited(kept: DataFrame, reads: DataFrame, most: int = MAX_PRODUCTS) -> DataFrame:
    """``completeness`` rows, incomplete also where a shop's kept listings are more than ``most``."""
    many = kept.groupBy("store").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("store", F.lit(f"more than {most} kept listings").alias("over"))
    out = reads.join(many, "store", "left").withColumn("complete", F.col("complete") & F.col("over").isNull())
    return out.withColumn("reason", F.when(F.col("over").isNotNull() | F.col("reason").isNotNull(), F.concat_ws("; ", "reason", "over"))).drop("over")


def slimmed(landed_pages: DataFrame) -> DataFrame:
    """Landed pages with only what the feed readers read: every product, its first image, and the
    fields of ``schema.SHOPIFY``; an answer that is no list of products stays as it is."""
    body = F.col("__body")
    landed_pages = _once_read(landed_pages, "__body", F.from_json("text", schema.SHOPIFY))
    first = F.transform(body["products"], lambda p: F.struct(p["id"], p["title"], p["handle"], p["vendor"], p["product_type"], F.slice(F.coalesce(p["images"], F.array().cast("array<struct<src:string>>")), 1, 1).alias("images"), p["variants"]))
    slim = F.to_json(F.struct(first.alias("products")))
    return landed_pages.withColumn("text", F.when(body["products"].isNotNull(), slim).otherwise(F.col("text"))).drop("__body")


def registry(spark: SparkSession, stores: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Shops that are read: code, host and kind of feed; by default the readers' kinds alone."""
    return spark.createDataFrame(stores or [], "store string, host string, feed string")


def allowed_hosts(shops: DataFrame) -> DataFrame:
    """Hosts that requests may go to: those of the shops, with and without www."""
    bare = F.regexp_replace(F.lower("host"), r"^www\.", "")
    return shops.select(F.explode(F.array(bare, F.concat(F.lit("www."), bare))).alias("host")).distinct()


def completeness(pages: DataFrame) -> DataFrame:
    """Per shop: complete only if every target ended on an empty page without a problem; else why."""
    target = pages.groupBy("store", "target").agg(F.bool_or(F.coalesce(F.size("items") == 0, F.lit(False))).alias("ended"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("page"))).alias("problem"))
    target = target.withColumn("reason", F.coalesce("problem", F.when(~F.col("ended"), F.lit("no empty page"))))
    out = target.groupBy("store").agg(F.bool_and(F.col("reason").isNull()).alias("complete"), F.sort_array(F.collect_set(F.concat_ws(": ", "target", "reason")), True).alias("why"), F.count_if(F.col("reason").isNotNull()).alias("n"))
    return out.select("store", "complete", F.when(F.col("n") > 0, F.array_join("why", "; ")).alias("reason"))


def once(listings: DataFrame) -> DataFrame:
    """The first of rows with one key in a shop's read, in feed order."""
    order = W.partitionBy("store", "store_product_id").orderBy("page", "position", "variant")
    return listings.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def shopify(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """One listing per variant: key is the trimmed sku, else the variant's id; rows without a
    key or a positive price are dropped.  ``pages``: landed ones, or these with their ``stop_reason``."""
    p = (pages if "problem" in pages.columns else stop_reason(pages, schema.SHOPIFY, max_pages)).select("store", "page", F.posexplode("items").alias("position", "p"), F.try_parse_url("url", F.lit("HOST")).alias("host"))
    v = p.select("*", F.posexplode("p.variants").alias("variant", "v"))
    key = F.coalesce(F.nullif(F.trim("v.sku"), F.lit("")), F.concat(F.lit("shopify-"), F.col("v.id").cast("string")))
    title, extra = F.trim("p.title"), F.trim("v.title")
    plain = extra.isNull() | (extra == "") | (F.lower(extra) == "default title") | (F.lower(extra) == F.lower(title)) | extra.rlike("^[A-Za-z0-9]*[0-9-][A-Za-z0-9-]*$")
    out = v.select("store", "page", "position", "variant", key.alias("store_product_id"), F.when(plain, title).otherwise(F.concat_ws(" ", title, extra)).alias("name"),
                   F.col("v.price").try_cast("decimal(10,3)").alias("price"), F.lit("JOD").alias("currency"), F.coalesce("v.available", F.lit(False)).alias("availability"),
                   F.concat(F.lit("https://"), F.col("host"), F.lit("/products/"), F.col("p.handle")).alias("url"), F.col("p.vendor").alias("brand"),
                   F.col("p.product_type").alias("category"), F.get("p.images", F.lit(0))["src"].alias("image_url"), F.lit(0).cast("decimal(10,3)").alias("delivery_cost"))
    return once(out.filter("store_product_id is not null and price > 0"))


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


def unescaped(text: Column) -> Column:
    """HTML entities resolved; text without any does not go to Python."""
    return F.when(F.contains(text, F.lit("&")), _unescape(text)).otherwise(text)


def woocommerce(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Simple products priced in JOD, from minor units; key is the sku, else the product's id."""
    p = stop_reason(pages, schema.WOOCOMMERCE, max_pages).select("store", "page", F.posexplode("items").alias("position", "p"))
    p = p.filter("p.type = 'simple' and p.prices.currency_code = 'JOD'")
    minor = F.element_at(F.array(*[F.lit(10**k) for k in range(7)]), F.least(F.greatest(F.col("p.prices.currency_minor_unit"), F.lit(0)), F.lit(6)) + 1)
    price = (F.col("p.prices.price").try_cast("decimal(18,0)") / minor).cast("decimal(10,3)")
    key = F.coalesce(F.nullif(F.trim("p.sku"), F.lit("")), F.concat(F.lit("woo-"), F.col("p.id").cast("string")))
    out = p.select("store", "page", "position", F.lit(0).alias("variant"), key.alias("store_product_id"), unescaped(F.col("p.name")).alias("name"), price.alias("price"), F.lit("JOD").alias("currency"),
                   F.coalesce("p.is_in_stock", F.lit(False)).alias("availability"), F.col("p.permalink").alias("url"), F.lit(None).cast("string").alias("brand"),
                   F.lit(None).cast("string").alias("category"), F.get("p.images", F.lit(0))["src"].alias("image_url"), F.lit(0).cast("decimal(10,3)").alias("delivery_cost"))
    return once(out.filter("store_product_id is not null and price > 0"))


#: Readers by the kind of feed that a shop has.
READERS = {"shopify": shopify, "woocommerce": woocommerce}


def read_registered(pages: DataFrame, shops: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Listings of the shops' pages with ``feed``, each by the reader of its shop's kind (``registry``).  Pages of
    shops that are not listed, of kinds without a reader, or from a host that is not their shop's are not read."""
    bare = lambda host: F.regexp_replace(F.lower(host), r"^www\.", "")
    known = shops.select("store", bare(F.col("host")).alias("__host"), F.col("feed").alias("__feed")).distinct()
    theirs = written(pages.join(known.filter(F.col("__feed").isin(*READERS)), "store").filter(bare(F.try_parse_url("url", F.lit("HOST"))) == F.col("__host")))  # for each reader to read
    found = [reader(theirs.filter(F.col("__feed") == kind), max_pages).withColumn("feed", F.lit(kind)) for kind, reader in READERS.items()]
    return reduce(DataFrame.unionByName, found)


def relevant(listings: DataFrame, held: bool = False) -> DataFrame:
    """Listings with a category, by the shop's own label where it says something.  Distinct titles and labels are
    parsed once, then joined back: many shops list one title.  ``held``: the listings are read, not computed, and the
    parsed titles are written, so that they go to the listings where their size allows it."""
    rows = listings if held else settled(listings)
    titles = rows.select(F.col("name").alias("__name"), F.col("category").alias("__label")).distinct()
    known = with_parsed(titles, "__name", "parsed", hint=F.col("__label")).filter("parsed.category is not null")
    known = written(known) if held else known
    return rows.join(known, (F.col("name") == F.col("__name")) & F.col("category").eqNullSafe(F.col("__label"))).drop("__name", "__label")


def robots_allows(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (host, path) with ``allowed``: of the rules (host, allow, pattern) that match,
    the longest decides, allowing ones win ties; no match allows.  ``*`` and a final ``$``."""
    end = F.endswith("pattern", F.lit("$"))
    body = F.when(end, F.expr("left(pattern, length(pattern) - 1)")).otherwise(F.col("pattern"))
    regex = F.concat(F.lit("^"), F.replace(F.concat(F.lit("\\Q"), F.replace(body, F.lit("*"), F.lit("\\E.*\\Q"))), F.lit("\\Q\\E"), F.lit("")), F.lit("\\E"), F.when(end, "$").otherwise(""))
    rule = F.struct(regex.alias("regex"), F.length("pattern").alias("size"), "allow")
    known = rules.filter("pattern <> ''").groupBy("host").agg(F.collect_list(rule).alias("rules"))
    asked = dealt(requests.select("host", "path"), "host").distinct().join(known, "host", "left")  # a row a request, not one a rule
    hits = F.filter("rules", lambda r: F.rlike(F.col("path"), r["regex"]))
    best = asked.select("host", "path", hits.alias("hits"))
    size = lambda allow: F.array_max(F.transform(F.filter("hits", lambda r: r["allow"] == allow), lambda r: r["size"]))
    return best.select("host", "path", (size(False).isNull() | F.coalesce(size(True) >= size(False), F.lit(False))).alias("allowed"))


def robots_rules(files: DataFrame) -> DataFrame:
    """Rules for all agents from robots files (host, text)."""
    lines = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*", "")))
    parts = lines.select("host", "n", F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))).alias("k"), F.trim(F.regexp_replace("line", "^[^:]*:?", "")).alias("v")).filter("k in ('user-agent', 'allow', 'disallow')")
    w = W.partitionBy("host").orderBy("n")
    starts = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    groups = parts.withColumn("start", starts.cast("int")).withColumn("grp", F.sum("start").over(w))
    groups = groups.withColumn("ours", F.max(((F.col("k") == "user-agent") & (F.col("v") == "*")).cast("int")).over(W.partitionBy("host", "grp")))
    return groups.filter("ours = 1 and k <> 'user-agent'").select("host", (F.col("k") == "allow").alias("allow"), F.col("v").alias("pattern"))
