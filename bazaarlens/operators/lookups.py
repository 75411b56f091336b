"""Small lookups of the back office: messages, accounts, names, photos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def messages(support: DataFrame, users: DataFrame, handled: bool | None = None, limit: int = 50) -> DataFrame:
    """Support messages, newest first, with the role of the user if there is one; all, or only
    the handled or the open ones."""
    chosen = support if handled is None else support.filter(F.col("handled") == handled)
    roles = users.select(F.col("id").alias("user_id"), "role")
    return chosen.join(roles, "user_id", "left").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def unhandled(support: DataFrame) -> DataFrame:
    return support.agg(F.count_if(~F.col("handled")).alias("unhandled"))


def same_name(stores: DataFrame, name: str) -> DataFrame:
    """Shops of a name, whatever its case; no character of it is a wildcard."""
    return stores.filter(F.lower("name") == F.lower(F.lit(name)))


def name_clashes(applied: DataFrame, stores: DataFrame) -> DataFrame:
    """Applications whose name a shop has already, whatever the case; no character is a wildcard."""
    taken = stores.select(F.lower("name").alias("__name")).distinct()
    return applied.join(taken, F.lower(applied["name"]) == F.col("__name"), "left_semi")


def by_email(users: DataFrame, email: str) -> DataFrame:
    return users.filter(F.lower("email") == email.lower())


def by_identity(identities: DataFrame, provider: str, subject: str) -> DataFrame:
    return identities.filter((F.col("provider") == provider) & (F.col("provider_subject") == subject))


def signed_in(sign_ins: DataFrame, identities: DataFrame, users: DataFrame) -> DataFrame:
    """What each sign-in (``id, at, provider, provider_subject, email, email_verified``) comes to, in order of time
    and id: ``known`` (the provider's subject is linked, also by an earlier sign-in; its address is not asked again),
    ``refused`` (not linked, and the provider does not vouch for an address), ``linked`` (to the account of the
    address, whatever its case) or ``created``.  ``user_id`` is that of an account there was before, else
    ``account`` is the address of the one created.  A null provider or subject is linked to nothing."""
    order, person = F.struct("at", "id"), ["provider", "provider_subject"]
    address = F.when(F.col("email_verified"), F.nullif(F.lower(F.trim("email")), F.lit("")))
    rows = sign_ins.select("id", "at", *person, address.alias("address"))
    linked = identities.groupBy(*person).agg(F.min("user_id").alias("linked"))
    # The first address that a provider vouches for links a subject; only persons, not sign-ins, meet the accounts.
    firsts = rows.filter(F.col("address").isNotNull() & F.col("provider").isNotNull() & F.col("provider_subject").isNotNull()).groupBy(*person).agg(F.min(order).alias("since"), F.min_by("address", order).alias("address"))
    firsts = firsts.join(linked, person, "left_anti")
    accounts = users.groupBy(F.lower("email").alias("address")).agg(F.min("id").alias("user_id"))
    makers = firsts.groupBy("address").agg(F.min("since").alias("made"))
    firsts = firsts.join(makers, "address").join(accounts, "address", "left").withColumnRenamed("address", "account")
    out = rows.drop("address").join(linked, person, "left").join(firsts, person, "left")
    here = F.struct("at", "id")
    action = (F.when(F.col("linked").isNotNull(), "known").when(F.col("since").isNull() | (here < F.col("since")), "refused").when(here > F.col("since"), "known")
              .when(F.col("user_id").isNull() & (F.col("since") == F.col("made")), "created").otherwise("linked"))
    out = out.withColumn("action", action).withColumn("user_id", F.when(F.col("action") != "refused", F.coalesce("linked", "user_id")))
    return out.select("id", "action", "user_id", F.when((F.col("action") != "refused") & F.col("user_id").isNull(), F.col("account")).alias("account"))


def with_photos(photos: DataFrame, listings: DataFrame, shops: DataFrame) -> DataFrame:
    """Distinct products of which a visible shop's listing has a photo; the pictures' bytes are
    in another column and are not read.  ``shops``: store_id."""
    return listings.join(shops, "store_id", "left_semi").join(photos.select("alias_id"), "alias_id", "left_semi").select("product_id").distinct()


def first_photo(photos: DataFrame, listings: DataFrame) -> DataFrame:
    """The oldest photo of each product."""
    rank = F.row_number().over(W.partitionBy("product_id").orderBy("uploaded_at", "id"))
    return photos.join(listings.select("alias_id", "product_id"), "alias_id").withColumn("rn", rank).filter("rn = 1").drop("rn")


def without_store_photos(photos: DataFrame, listings: DataFrame, store_id: int) -> DataFrame:
    """Photos that are left when a shop's are deleted."""
    return photos.join(listings.filter(F.col("store_id") == store_id).select("alias_id"), "alias_id", "left_anti")
