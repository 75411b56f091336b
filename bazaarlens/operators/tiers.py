"""Candidates that can reach a tier, by weighted prefix filtering.

A query specifies attributes; every one that differs costs its weight, and a candidate that loses
more than ``ALLOWED`` of 100 reaches no tier.  So a candidate that counts agrees in all specified
attributes but some whose weights come to ``ALLOWED`` at most.  Each query is looked up under every
largest set of attributes it may disagree in, by the values of all the others; products are listed
under the sets that queries ask for.  Gates and the brand must always agree.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions.parse import CATEGORIES
from bazaarlens.functions.score import score_match

#: Points that a candidate of the lowest tier may lose.
ALLOWED = 30


def forgiven(weights: dict[str, int], allowed: int = ALLOWED) -> list[tuple[str, ...]]:
    """The largest sets of these attributes whose weights come to ``allowed`` at most."""
    sets = [set(s) for n in range(len(weights) + 1) for s in combinations(sorted(weights), n) if sum(weights[a] for a in s) <= allowed]
    return sorted(tuple(sorted(s)) for s in sets if not any(s < other for other in sets))


def patterns() -> list[tuple[str, tuple[str, ...], tuple[str, ...]]]:
    """Category, attributes a query specifies, attributes that must agree: all there can be, by rule."""
    out = []
    for c in CATEGORIES:
        fixed = {a.name for a in c.attributes if a.gate} | {"brand"}
        weights = {a.name: a.weight for a in c.attributes if not a.gate and a.name != "brand"}
        free = sorted(fixed | set(weights))
        for n in range(len(free) + 1):
            for said in combinations(free, n):
                open_ = {a: w for a, w in weights.items() if a in said}
                out += [(c.name, said, tuple(a for a in said if a not in gone)) for gone in forgiven(open_) if open_]
    return out


def _said(parsed: Column) -> Column:
    """Names of the attributes of its category that a parse has, as one string."""
    names = [F.when(parsed["category"] == c.name, F.concat_ws(",", *[F.when(parsed["attributes"][a].isNotNull(), F.lit(a)) for a in sorted({x.name for x in c.attributes} | {"brand"})])) for c in CATEGORIES]
    return F.coalesce(*names)


def _value(attributes: Column, agree: Column) -> Column:
    """What must agree: a parse's values of these attributes, null where one is missing."""
    return F.to_json(F.transform(F.filter(F.split(agree, ","), lambda a: a != ""), lambda a: F.coalesce(attributes[a], F.lit("\x00"))))


def near(queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Queries (``query_id, q``) with the products (``c``) that reach a tier, scored once: what
    ``search.candidates`` and ``score_match`` give without the excluded."""
    known = queries.sparkSession.createDataFrame([(c, ",".join(said), ",".join(agree)) for c, said, agree in patterns()], "category string, said string, agree string")
    asked = queries.filter("q.category is not null").withColumn("category", F.col("q.category")).withColumn("said", _said(F.col("q")))
    asked = asked.join(F.broadcast(known), ["category", "said"]).drop("said")  # as many rows as the rules have patterns
    asked = asked.withColumn("key", _value(F.col("q.attributes"), F.col("agree")))
    used = asked.select("category", "agree").distinct()
    listed = catalogue.withColumn("category", F.col("c.category")).join(F.broadcast(used), "category")  # patterns again
    listed = listed.withColumn("key", _value(F.col("c.attributes"), F.col("agree")))
    # A pair that several sets bring together counts under the first of them, so no shuffle has to find it again.
    met = asked.join(listed, ["category", "agree", "key"])
    first = F.array_min(F.filter(F.col("sets"), lambda s: _value(F.col("q.attributes"), s) == _value(F.col("c.attributes"), s)))
    sets = asked.groupBy("query_id").agg(F.collect_set("agree").alias("sets"))
    met = met.join(sets, "query_id").filter(F.col("agree") == first).drop("sets", "agree", "key")
    return met.withColumn("match", score_match(F.col("q"), F.col("c"))).filter("match.tier <> 'excluded'")
