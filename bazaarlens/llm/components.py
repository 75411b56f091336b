"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on distinct edges (u, v), u > v.  Large: each node links its larger neighbours
    to the smallest of its neighbours and itself.  Small: each node links its smaller
    neighbours and itself to the smallest of them.  The smallest is found by a combining
    aggregate, so a hub's edges are never gathered in one place."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str, most: int | None = None) -> DataFrame:
    """``node, component`` for every node of ``edges`` (a, b) that is not the smallest of its
    component; the component is the smallest node.  Empty for no edges.  ``most``: edges at most."""
    at = 0
    now = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), f"{name}-{at}", most)
    facts = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = facts(now)
    while before[0]:
        large = scratch.table(_star(now, True), f"{name}-{at}-large", most=2 * before[0])
        at += 1
        now = scratch.table(_star(large, False), f"{name}-{at}", most=2 * before[0])
        after = facts(now)
        scratch.drop(f"{name}-{at - 1}-large")
        scratch.drop(f"{name}-{at - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
