"""How well a candidate answers a query: score, tier, and the attributes that differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions.parse import CATEGORIES

COMPARISON = "array<struct<name:string,label:string,weight:int,query_value:string,candidate_value:string,matched:boolean>>"


def tier(score: Column) -> Column:
    return F.when(score >= 100, "exact").when(score >= 85, "close").when(score >= 70, "similar").otherwise("excluded")


def _compare(query: Column, candidate: Column, gate: bool) -> Column:
    """Comparisons of what the query specifies, by its category's rules."""
    rules = F.coalesce(*[
        F.when(query["category"] == c.name, F.array(*[F.struct(F.lit(a.name).alias("name"), F.lit(a.label).alias("label"), F.lit(a.weight).alias("weight")) for a in c.attributes if a.gate == gate]))
        for c in CATEGORIES
    ])
    said = F.filter(rules, lambda r: query["attributes"][r["name"]].isNotNull())
    return F.transform(said, lambda r: F.struct(
        r["name"].alias("name"), r["label"].alias("label"), r["weight"].alias("weight"),
        query["attributes"][r["name"]].alias("query_value"), candidate["attributes"][r["name"]].alias("candidate_value"),
        query["attributes"][r["name"]].eqNullSafe(candidate["attributes"][r["name"]]).alias("matched"),
    )).cast(COMPARISON)


def score_match(query: Column, candidate: Column) -> Column:
    """struct<score, tier, comparisons>: 100 less the weights of specified attributes that
    differ; 0 and excluded for another category, a gate that differs (then the only
    comparison), or a query that specifies nothing scored."""
    none = F.array().cast(COMPARISON)
    closed = F.filter(_compare(query, candidate, gate=True), lambda c: ~c["matched"])
    scored = _compare(query, candidate, gate=False)
    lost = F.aggregate(F.filter(scored, lambda c: ~c["matched"]), F.lit(0), lambda s, c: s + c["weight"])
    same = F.coalesce(query["category"] == candidate["category"], F.lit(False))
    out = lambda score, comparisons, kind=None: F.struct(score.cast("double").alias("score"), (tier(score) if kind is None else F.lit(kind)).alias("tier"), comparisons.alias("comparisons"))
    return (F.when(~same, out(F.lit(0), none, "excluded")).when(F.size(closed) > 0, out(F.lit(0), F.slice(closed, 1, 1), "excluded"))
            .when(F.size(scored) == 0, out(F.lit(0), none, "excluded")).otherwise(out(F.lit(100) - lost, scored)))


def differences(match: Column) -> Column:
    return F.filter(match["comparisons"], lambda c: ~c["matched"])


def describe(difference: Column) -> Column:
    """A sentence part for one difference: what is missing, or how it differs."""
    return F.when(difference["candidate_value"].isNull(), F.format_string("%s not stated", difference["label"])).otherwise(
        F.format_string("%s %s instead of %s", difference["label"], difference["candidate_value"], difference["query_value"]))


def identity(parsed: Column) -> Column:
    """A key that two listings share exactly if each answers the other fully: category, brand
    and all scored attributes equal, one of these specified.  Null if nothing is."""
    keys = []
    for c in CATEGORIES:
        names = [a.name for a in c.attributes]
        scored = F.coalesce(*[parsed["attributes"][a.name] for a in c.attributes if not a.gate])
        keys.append(F.when((parsed["category"] == c.name) & scored.isNotNull(), F.to_json(F.struct(F.lit(c.name).alias("category"), *[parsed["attributes"][n].alias(n) for n in names]))))
    return F.coalesce(*keys)
