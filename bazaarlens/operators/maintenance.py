"""Repairs of the catalogue: merge duplicates, prune, clean up, audit links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.functions.parse import canonical

VERDICTS = ("OK", "RENAMED", "VARIANT_GONE", "GONE", "UNKNOWN")


def duplicate_groups(products: DataFrame) -> DataFrame:
    """Products of equal category and attributes: survivor (smallest id), members, and the
    longest mixed-case name (else the longest), the smallest id's of several."""
    mixed = F.when(F.col("canonical_name") != F.lower("canonical_name"), F.struct(F.length("canonical_name").alias("n"), (-F.col("id")).alias("i")))
    out = products.filter("match_category is not null").withColumn("key", canonical(F.col("attributes"))).groupBy("match_category", "key").agg(
        F.min("id").alias("survivor"), F.count("*").alias("members"), F.max_by("canonical_name", mixed).alias("mixed_name"),
        F.max_by("canonical_name", F.struct(F.length("canonical_name"), -F.col("id"))).alias("long_name"))
    return out.filter("members > 1").select("match_category", "survivor", "members", F.coalesce("mixed_name", "long_name").alias("best_name"))


def survivors(products: DataFrame) -> DataFrame:
    """id and survivor of every product that has duplicates."""
    keyed = products.filter("match_category is not null").select("id", "match_category", canonical(F.col("attributes")).alias("key"))
    first = keyed.groupBy("match_category", "key").agg(F.min("id").alias("survivor"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keyed.join(first, ["match_category", "key"]).select("id", "survivor")


def repointed(rows: DataFrame, moved: DataFrame, unique_by: list[str] | None = None) -> DataFrame:
    """Rows with ``product_id`` moved to the survivor; of rows that then agree in
    ``unique_by`` the smallest id stays."""
    out = rows.join(moved.select(F.col("id").alias("product_id"), "survivor"), "product_id", "left").withColumn("product_id", F.coalesce("survivor", "product_id")).drop("survivor")
    if unique_by:
        out = out.withColumn("rn", F.row_number().over(W.partitionBy(*unique_by).orderBy("id"))).filter("rn = 1").drop("rn")
    return out


def backfilled(reparsed: DataFrame, alias_names: DataFrame) -> DataFrame:
    """Products that parse (``parsed``), with category and attributes from it; a name all in
    small letters gives way to the longest mixed-case name of the product's listings."""
    mixed = alias_names.filter(F.col("name") != F.lower("name")).groupBy(F.col("product_id").alias("id")).agg(F.max_by("name", F.struct(F.length("name"), -F.col("alias_id"))).alias("better"))
    out = reparsed.filter("parsed.category is not null").join(mixed, "id", "left")
    plain = F.col("canonical_name") == F.lower("canonical_name")
    return out.select("id", F.when(plain, F.coalesce("better", "canonical_name")).otherwise(F.col("canonical_name")).alias("canonical_name"), F.col("parsed.category").alias("match_category"), F.col("parsed.attributes").alias("match_attributes"))


def cleanup(users: DataFrame, stores: DataFrame, listings: DataFrame, wishes: DataFrame, alerts: DataFrame, doomed_users: DataFrame) -> dict[str, DataFrame]:
    """What goes with some users (column id): their shops, products that only these carry, how
    many rows of others refer to them; and whether to refuse, as no administrator would stay."""
    gone_stores = stores.join(doomed_users.select(F.col("id").alias("owner_user_id")), "owner_user_id", "left_semi").select("id")
    theirs = listings.join(gone_stores.select(F.col("id").alias("store_id")), "store_id", "left_semi")
    stranded = theirs.select("product_id").distinct().join(listings.join(gone_stores.select(F.col("id").alias("store_id")), "store_id", "left_anti").select("product_id"), "product_id", "left_anti")
    referring = wishes.select("user_id", "product_id").unionByName(alerts.select("user_id", "product_id")).join(doomed_users.select(F.col("id").alias("user_id")), "user_id", "left_anti")
    left = users.join(doomed_users.select("id"), "id", "left_anti").filter("role = 'admin'")
    return {"stores": gone_stores, "products": stranded, "referring": referring.join(stranded, "product_id", "left_semi").agg(F.count("*").alias("n")), "refuse": left.agg((F.count("*") == 0).alias("refuse"))}


def orphans(products: DataFrame, listings: DataFrame) -> DataFrame:
    """Products that no listing is of.  Each listed product meets them once, however many listings it has."""
    return products.join(listings.select(F.col("product_id").alias("id")).distinct(), "id", "left_anti")


def references(products: DataFrame, *tables: DataFrame) -> DataFrame:
    """How many rows of the tables refer to each product that any refers to."""
    used = tables[0].select("product_id")
    for more in tables[1:]:
        used = used.unionByName(more.select("product_id"))
    return used.join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi").groupBy("product_id").agg(F.count("*").alias("n"))


def unparsed(reparsed: DataFrame, parsed: str = "c") -> DataFrame:
    """Products that no longer parse to a category."""
    return reparsed.filter(F.col(parsed)["category"].isNull())


def prune_report(reparsed: DataFrame, parsed: str = "c") -> DataFrame:
    """Products that no longer parse, by the category stored for them, most first."""
    return unparsed(reparsed, parsed).groupBy(F.coalesce("match_category", F.lit("-")).alias("stored")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stored")


def prune_guard(doomed: DataFrame, *references: DataFrame) -> DataFrame:
    """Doomed products that something still refers to; any row is a reason to refuse."""
    used = references[0].select("product_id")
    for more in references[1:]:
        used = used.union(more.select("product_id"))
    return doomed.select(F.col("id").alias("product_id")).intersect(used.distinct())


def pruned(products: DataFrame, reparsed: DataFrame, *references: DataFrame, parsed: str = "c") -> DataFrame:
    """Products without those that no longer parse and that nothing refers to."""
    doomed = unparsed(reparsed, parsed).select("id")
    kept = prune_guard(doomed, *references).select(F.col("product_id").alias("id"))
    return products.join(doomed.join(kept, "id", "left_anti"), "id", "left_anti")


def safe_handle(handle: Column) -> Column:
    """Whether a handle may stand in an address: at most 255 characters, no two dots in a row, and
    none that ends or escapes a part of a path."""
    plain = (F.length(handle) <= 255) & handle.rlike(r"^[^\s/\\?#%\x00-\x1f\x7f]+$")
    return F.coalesce(plain & ~F.contains(handle, F.lit("..")), F.lit(False))


def select_links(offers: DataFrame, per_store: int | None = None) -> DataFrame:
    """Links to audit: those of current offers of scraped shops, one row per shop and address, with
    its listings and their keys; of each shop the first ``per_store`` in order."""
    out = offers.filter("owner_user_id is null and url is not null").groupBy("store_id", "url").agg(F.count("*").alias("listings"), F.sort_array(F.collect_list(F.struct("alias_id", "store_product_id"))).alias("keys"))
    if per_store:
        out = out.withColumn("rn", F.row_number().over(W.partitionBy("store_id").orderBy("url"))).filter(F.col("rn") <= per_store).drop("rn")
    return out


def prepared_links(listings: DataFrame, hosts: tuple[str, ...], per_store: int | None = None) -> DataFrame:
    """Distinct links per shop with their listings; whether each has the shape of a product
    page on an allowed host, and its handle."""
    host, path = F.try_parse_url("url", F.lit("HOST")), F.try_parse_url("url", F.lit("PATH"))
    handle = F.nullif(F.regexp_extract(path, r"^/products/([^/]+)/?$", 1), F.lit(""))
    fine = (F.try_parse_url("url", F.lit("PROTOCOL")) == "https") & host.isin(*hosts) & safe_handle(F.col("handle"))
    # An array of one, exploded: the handle is found once and not wherever it is referred to.
    out = listings.groupBy("store_id", "url").agg(F.count("*").alias("listings")).withColumn("handle", F.explode(F.array(handle))).withColumn("well_formed", F.coalesce(fine, F.lit(False)))
    if per_store:
        out = out.withColumn("rn", F.row_number().over(W.partitionBy("store_id").orderBy("url"))).filter(F.col("rn") <= per_store).drop("rn")
    return out


def link_verdict(status: Column, handle: Column, answered: Column, present: Column) -> Column:
    """What a recorded answer says of a listing: handle asked for, handle answered, and whether
    the listing's variant is in the answer (null: it has no key)."""
    return (F.when(status == 404, "GONE").when((status != 200) | answered.isNull(), "UNKNOWN").when(F.coalesce(~present, F.lit(False)), "VARIANT_GONE")
            .when(answered != handle, "RENAMED").otherwise("OK"))


def variant_present(key: Column, variants: Column) -> Column:
    """Whether the listing's sku, or variant id, is among an answer's variants; null without a key."""
    hit = F.exists(variants, lambda v: (F.trim(v["sku"]) == key) | (F.concat(F.lit("shopify-"), v["id"].cast("string")) == key))
    return F.when(key.isNotNull(), F.coalesce(hit, F.lit(False)))


ANSWER = "struct<handle:string,variants:array<struct<id:bigint,sku:string>>>"


def audited(listings: DataFrame, answers: DataFrame, hosts: tuple[str, ...]) -> DataFrame:
    """Listings (``alias_id, store_id, url, store_product_id``) with what the recorded answers (``store_id, url,
    status_code, text``) say of them: a verdict each.  A link that has not the shape of a product's page was not
    asked for, and one without an answer or with one that cannot be read is unknown."""
    links = prepared_links(listings, hosts).drop("listings")
    told = answers.select("store_id", "url", "status_code", F.explode(F.array(F.from_json("text", ANSWER))).alias("answer"))
    asked = links.join(told, ["store_id", "url"], "left")
    status = F.when(F.col("well_formed"), F.coalesce("status_code", F.lit(599))).otherwise(599)
    found = asked.select("store_id", "url", "handle", status.alias("status"), "answer")
    verdict = link_verdict(F.col("status"), F.col("handle"), F.col("answer.handle"), variant_present(F.col("store_product_id"), F.col("answer.variants")))
    return listings.join(found, ["store_id", "url"]).select("alias_id", "store_id", "url", verdict.alias("verdict"))


def audit_summary(judged: DataFrame) -> DataFrame:
    """Per shop the links of each verdict, and whether delisting the gone ones would be a mass
    removal: more than 3 and more than a fifth."""
    out = judged.groupBy("store_id").agg(*[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in VERDICTS], F.count("*").alias("checked"))
    gone = F.col("gone") + F.col("variant_gone")
    return out.withColumn("mass_removal", gone > F.greatest(F.lit(3), F.floor(F.col("checked") * 0.2)))


def guarded(changes: DataFrame, listings: DataFrame) -> DataFrame:
    """Changes with ``applied``: only where the listing still has the audited url and shows."""
    now = listings.filter("delisted_at is null").select("alias_id", "url", F.lit(True).alias("same"))
    return changes.join(now, ["alias_id", "url"], "left").withColumn("applied", F.coalesce("same", F.lit(False))).drop("same")


def account_removed(user_id: int, **tables: DataFrame) -> dict[str, DataFrame]:
    """Tables after an account is deleted: its wishes and alerts go, messages lose the user,
    its shop is retired and ownerless."""
    out = dict(tables)
    for name in ("wishlist_items", "price_alerts", "users"):
        if name in out:
            key = "id" if name == "users" else "user_id"
            out[name] = out[name].filter(F.col(key) != user_id)
    if "support_messages" in out:
        out["support_messages"] = out["support_messages"].withColumn("user_id", F.when(F.col("user_id") != user_id, F.col("user_id")))
    if "stores" in out:
        own = F.coalesce(F.col("owner_user_id") == user_id, F.lit(False))
        out["stores"] = out["stores"].withColumn("is_active", F.when(own, 0).otherwise(F.col("is_active"))).withColumn("owner_user_id", F.when(~own, F.col("owner_user_id")))
    return out


def product_removed(product_ids: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Tables after products go: rows that belong to them go, taps keep but lose the product.
    ``product_ids``: column id."""
    gone = product_ids.select(F.col("id").alias("product_id"), F.lit(True).alias("gone"))
    out = {}
    for name, df in tables.items():
        if name == "contact_events":
            out[name] = df.join(gone, "product_id", "left").withColumn("product_id", F.when(F.col("gone").isNull(), F.col("product_id"))).drop("gone")
        else:
            key = "id" if name == "products" else "product_id"
            out[name] = df.join(gone.select(F.col("product_id").alias(key)), key, "left_anti")
    return out


def token_state(tokens: DataFrame, now: Column, cooldown_minutes: int = 2, keep_days: int = 30) -> DataFrame:
    """Single-use tokens with ``usable`` (the newest of user and purpose, not consumed or
    expired), ``may_resend`` and ``purge``."""
    newest = F.row_number().over(W.partitionBy("user_id", "purpose").orderBy(F.desc("created_at"), F.desc("id"))) == 1
    return tokens.select("*", (newest & F.col("consumed_at").isNull() & (F.col("expires_at") > now)).alias("usable"),
                         (newest & (F.col("created_at") <= now - F.make_dt_interval(mins=F.lit(cooldown_minutes)))).alias("may_resend"),
                         (F.col("expires_at") < now - F.make_dt_interval(F.lit(keep_days))).alias("purge"))
