"""Search: candidates of a query, scored into tiers, sorted and paged within each tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.functions.normalize import contains_folded, expand_prefix, normalize
from bazaarlens.functions.parse import with_parsed
from bazaarlens.functions.score import differences, score_match
from bazaarlens.functions.spelling import accepted, correct
from bazaarlens.operators import tiers
from bazaarlens.operators.names import containing
from bazaarlens.session import settled

TIERS = ("exact", "close", "similar")


def candidates(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Queries (``query_id, q``: parsed) with the products (``product_id, c``: parsed) of their
    category, and of their brand where they name one: two equi-joins, no cross product."""
    asked = queries.withColumn("category", F.col("q.category")).withColumn("brand", F.col("q.attributes")["brand"]).filter("category is not null")
    offered = catalogue.withColumn("category", F.col("c.category")).withColumn("brand", F.col("c.attributes")["brand"])
    named = asked.filter("brand is not null").join(offered, ["category", "brand"])
    open_ = asked.filter("brand is null").drop("brand").join(offered, "category")
    return named.unionByName(open_)


def _told(pairs: DataFrame, usable: bool) -> DataFrame:
    """Pairs with a ``match`` as results: those that answer, or (of a query that nothing answers) all,
    unscored and without differences, as similar."""
    tier, score, gaps = (F.col("match.tier"), F.col("match.score"), differences(F.col("match"))) if usable else (F.lit("similar"), F.lit(0.0), F.slice(F.col("match.comparisons"), 1, 0))
    return pairs.withColumn("tier", tier).withColumn("score", score).withColumn("differences", gaps)


def scored(pairs: DataFrame) -> DataFrame:
    """Candidates with their match, the excluded left out.  A query that no candidate answers
    keeps all of its candidates, unscored and without differences, as similar."""
    out = settled(pairs.withColumn("match", score_match(F.col("q"), F.col("c"))))  # scored once, read twice
    good = out.filter("match.tier <> 'excluded'")
    return _told(good, True).unionByName(_told(out.join(good.select("query_id").distinct(), "query_id", "left_anti"), False))


def tiered(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``scored(candidates(queries, catalogue))`` without meeting what no tier can take: only where
    nothing reaches one, all products of the query's category and brand are paired."""
    good = settled(tiers.near(queries, catalogue))
    wide = candidates(queries.join(good.select("query_id").distinct(), "query_id", "left_anti"), catalogue).drop("brand")
    return _told(good, True).unionByName(_told(wide.withColumn("match", score_match(F.col("q"), F.col("c"))), False), allowMissingColumns=True)


def sort_keys(name: str) -> list[Column]:
    """Order within a tier; products without a price come last either way."""
    price = F.col("lowest_total")
    return {
        "price_asc": [price.isNull(), price.asc(), F.col("product_id")],
        "price_desc": [price.isNull(), price.desc(), F.col("product_id")],
        "name": [F.lower("canonical_name"), F.col("product_id")],
        "relevance": [F.desc("score"), price.isNull(), price.asc(), F.col("product_id")],
    }[name]


def tier_page(results: DataFrame, sort: str = "price_asc", start: int = 0, stop: int = 10) -> DataFrame:
    """Rows [start, stop) of each tier of each query, with the tier's full count, and whether any
    tier of the query has more."""
    by = W.partitionBy("query_id", "tier")
    # Rank, then first rows, then the page: in this form Spark drops what is beyond it before the shuffle.
    out = results.withColumn("nth", F.row_number().over(by.orderBy(*sort_keys(sort)))).filter(F.col("nth") <= stop)
    out = out.filter(F.col("nth") > start).withColumn("place", F.col("nth") - 1).drop("nth")
    counts = results.groupBy("query_id", "tier").agg(F.count("*").alias("tier_count"))
    more = counts.groupBy("query_id").agg(F.bool_or(F.col("tier_count") > stop).alias("has_more"))
    return out.join(counts, ["query_id", "tier"]).join(more, "query_id")


def after(results: DataFrame, cursors: DataFrame | None, sort: str = "price_asc", size: int = 10) -> DataFrame:
    """The next ``size`` rows of each tier of each query behind its cursor (``query_id, tier`` and the
    ``cursor`` of the last row seen, as ``cursors_of`` gives them); from the first row where a tier has none.  Rows carry their own
    ``cursor``.  What lies before is filtered before any ranking, so a deep page costs what a first does."""
    keys = [k.alias(f"k{n}") for n, k in enumerate(cursor_keys(sort))]
    rest = results.withColumn("cursor", F.struct(*keys))
    if cursors is not None:
        rest = rest.join(cursors.select("query_id", "tier", F.col("cursor").alias("seen")), ["query_id", "tier"], "left").filter(F.col("seen").isNull() | (F.col("cursor") > F.col("seen"))).drop("seen")
    nth = F.row_number().over(W.partitionBy("query_id", "tier").orderBy("cursor"))
    return rest.withColumn("nth", nth).filter(F.col("nth") <= size).drop("nth")


def cursors_of(page: DataFrame, before: DataFrame | None) -> DataFrame:
    """Where each tier has been read to with this page; a tier that has ended keeps its last cursor."""
    rows = page.select("query_id", "tier", "cursor")
    return (rows.unionByName(before) if before is not None else rows).groupBy("query_id", "tier").agg(F.max("cursor").alias("cursor"))


def cursor_keys(name: str) -> list[Column]:
    """``sort_keys`` as values that all ascend: equal orders, and a struct of them compares as a whole."""
    price = F.col("lowest_total")
    return {
        "price_asc": [price.isNull(), price, F.col("product_id")],
        "price_desc": [price.isNull(), -price, F.col("product_id")],
        "name": [F.lower("canonical_name"), F.col("product_id")],
        "relevance": [-F.col("score"), price.isNull(), price, F.col("product_id")],
    }[name]


def by_name(products: DataFrame, terms: list[Column], names: list[str]) -> DataFrame:
    """Products in which any of the names contains any of the terms."""
    hit = F.lit(False)
    for n in names:
        for term in terms:
            hit = hit | F.coalesce(contains_folded(F.col(n), term), F.lit(False))
    return products.filter(hit)


def typed_terms(typed: DataFrame) -> DataFrame:
    """``query_id, term``: what each half-typed text (``query_id, q_text``) is looked up by: itself, corrected
    and normalised, and with its last Arabic word completed; in small letters, each once, none empty."""
    asked = typed.select("query_id", F.trim("q_text").alias("q_text")).filter("q_text <> ''")
    fixed = correct(asked, "query_id", "q_text")
    terms = F.array(normalize(F.col("corrected")), normalize(expand_prefix(F.col("corrected"))), F.lower("text"))
    return fixed.select(F.col("id").alias("query_id"), F.explode(F.array_distinct(terms)).alias("term")).filter("term <> ''")


def type_ahead(typed: DataFrame, products: DataFrame, offers: DataFrame, limit: int = 8) -> DataFrame:
    """The first ``limit`` suggestions for each half-typed text: categorised products with an offer whose
    name contains one of its terms, the shortest name first."""
    terms = settled(typed_terms(typed))
    shown = products.filter("match_category is not null").join(offers.select(F.col("product_id").alias("id")), "id", "left_semi").select("id", "canonical_name", F.lower("canonical_name").alias("folded"))
    hits = terms.join(containing(terms.select("term"), shown.select(F.col("canonical_name").alias("name"))), "term")
    found = hits.select("query_id", "folded").distinct().join(shown, "folded")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.length("canonical_name"), "id"))
    return found.withColumn("place", nth).filter(F.col("place") <= limit).drop("folded")


def suggestions(products: DataFrame, offers: DataFrame, terms: list[Column], limit: int = 8) -> DataFrame:
    """Type-ahead: offered products whose name contains a term, shortest name first."""
    found = by_name(products.filter("match_category is not null"), terms, ["canonical_name"])
    found = found.join(offers.select(F.col("product_id").alias("id")), "id", "left_semi")
    return found.orderBy(F.length("canonical_name"), "id").limit(limit)


def understood(queries: DataFrame, id_col: str = "query_id", text_col: str = "q_text") -> DataFrame:
    """What each typed query asks for: ``q`` (parsed without evidence or defaults), ``normalized``,
    and, where a spelling correction makes it specify more, ``corrected_query`` and ``corrections``."""
    asked = queries.select(F.col(id_col).alias("query_id"), F.coalesce(F.col(text_col), F.lit("")).alias("q_text"))
    typed = with_parsed(asked, "q_text", "typed", evidence=False, defaults=False, normalized="typed_text")
    fixes = correct(asked, "query_id", "q_text").filter(F.size("corrections") > 0).select(F.col("id").alias("query_id"), "corrected", "corrections")
    fixed = with_parsed(fixes, "corrected", "fixed", evidence=False, defaults=False, normalized="fixed_text")
    both = typed.join(fixed, "query_id", "left")
    take = F.coalesce(accepted(F.col("typed"), F.col("fixed")), F.lit(False))
    return both.select("query_id", "q_text", F.when(take, F.col("fixed")).otherwise(F.col("typed")).alias("q"), F.when(take, F.col("fixed_text")).otherwise(F.col("typed_text")).alias("normalized"),
                       F.when(take, F.col("corrected")).alias("corrected_query"), F.when(take, F.col("corrections")).alias("corrections"))


def named_candidates(asked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Queries with the products whose name or brand holds the query's text or its normalised form:
    terms meet distinct names through an index of letter runs, and names their products by key."""
    terms = F.filter(F.array_distinct(F.array(F.trim(F.coalesce("corrected_query", "q_text")), F.col("normalized"))), lambda t: t != "")
    typed = settled(asked.select("query_id", F.explode(terms).alias("term")))
    named = catalogue.select("product_id", F.explode(F.array_distinct(F.array(F.lower("canonical_name"), F.lower("brand")))).alias("folded")).filter("folded is not null")
    hits = containing(typed.select("term"), named.select(F.col("folded").alias("name")))
    pairs = typed.join(hits, "term").join(named, "folded").select("query_id", "product_id").distinct()
    return asked.join(pairs, "query_id").join(catalogue, "product_id")


def answered(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Results of typed queries: candidates by what a query specifies; where that finds nothing, by
    name; scored, or as similar where none can be scored.  ``catalogue``: product_id,
    canonical_name, brand (as stored) and ``c`` (parsed) of the products that have an offer."""
    asked = settled(understood(queries))
    told = asked.filter(F.size("q.attributes") > 0)
    structured = settled(tiered(told, catalogue.drop("brand")).drop("category"))
    rest = asked.join(structured.select("query_id").distinct(), "query_id", "left_anti")
    return structured.unionByName(scored(named_candidates(rest, catalogue).drop("brand")))
