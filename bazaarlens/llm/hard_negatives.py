"""Hard negatives by vantage-point trees over norm-augmented vectors.

Vectors become integers floor(256 * x).  A tree's vectors are given one more component,
sqrt(M**2 - |x|**2) with M the largest norm, which a query has as 0: then the squared distance is
M**2 + |q|**2 - 2 * score, so the best scores are the nearest points and a window of scores is an
annulus around the query.  A tree halves its points by their distance to a vantage point, again and
again, and keeps the least and largest distance of either half.  By the triangle inequality these
bound the distance of a query to each leaf.  Leaves that meet the annulus are visited nearest first,
a few more at each turn, until the k-th find is nearer than what any other leaf can hold.  What is
visited is scored exactly.

The table is dealt into parts of at most ``HELD`` bytes, a tree each; the trees are written once and
serve both rounds: the anchors' positives (same label, no window), then, for each anchor and
different positive score, the negatives (other labels, window).  Parts meet groups of queries, one
pair a task, so a task holds one part and one group and gives out k rows a query at most.

Equal vectors of one label are one point with their smallest ids, enough for any result.

Defined results: a row without id or label, a null vector, one without components or with a null,
NaN or infinite one takes no part; vectors of another length than the anchor's are not compared with
it; rows equal in id, label and vector count once; no anchor meets rows of its own id; several
anchor rows of one id are anchors each; scores count as the nearest long; an anchor without a
positive, or a positive without a negative in its window, gives no row; a negative positive score has
an empty window; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.llm.scratch import Scratch
from bazaarlens.llm.va_search import integers, usable

#: Points of a leaf; bytes of points and of queries that a task holds; queries that go down a tree at once.
LEAF, HELD, QUERIES = 256, 32 << 20, 256
LEAST, MOST = -(2**63), 2**63 - 1
TREE = "dim int, part int, keep int, x binary, label binary, ids binary, n_ids binary, vantage binary, near binary, far binary"


def _augmented(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Points with the component that gives all of them the norm M, and M."""
    x = x.astype(np.float64)
    square = (x * x).sum(axis=1)
    most = float(square.max())
    return np.concatenate([x, np.sqrt(np.maximum(most - square, 0.0))[:, None]], axis=1), math.sqrt(most)


def _distances(points: np.ndarray, to: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(2 * most * most - 2 * (points @ to), 0.0))


def bounds(n: int, leaves: int) -> np.ndarray:
    """Where each of the leaves begins and ends among n points in tree order."""
    return np.arange(leaves + 1) * n // leaves


def grown(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points in the tree, vantage points by node (node k has children 2k+1 and 2k+2),
    and the least and largest distance of each child's points to its parent's vantage point."""
    points, most = _augmented(x)
    levels = max(0, math.ceil(math.log2(len(x) / leaf)))
    order, cuts = np.arange(len(x)), bounds(len(x), 1 << levels)
    vantage = np.zeros(((1 << levels) - 1, points.shape[1]))
    near, far = np.zeros((2 << levels) - 1), np.full((2 << levels) - 1, np.inf)
    for level in range(levels):
        for k in range(1 << level):
            node, width = (1 << level) - 1 + k, 1 << (levels - level)
            a, mid, b = (cuts[k * width + s] for s in (0, width // 2, width))
            own = points[order[a:b]]
            vantage[node] = own[np.argmax(_distances(own, own[0], most))]  # a far corner splits best
            d = _distances(own, vantage[node], most)
            by = np.argpartition(d, mid - a) if 0 < mid - a < b - a else np.argsort(d)
            order[a:b], d = order[a:b][by], d[by]
            for child, part in ((2 * node + 1, d[: mid - a]), (2 * node + 2, d[mid - a :])):
                near[child], far[child] = (part.min(), part.max()) if len(part) else (np.inf, np.inf)
    return order, vantage, near, far


class Tree:
    """One part's points in tree order, and the search of it."""

    def __init__(self, row: dict) -> None:
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.x = read("x", np.int64).reshape(-1, row["dim"])
        self.label, self.n_ids = read("label", np.int64), read("n_ids", np.int64)
        self.ids = read("ids", np.int64).reshape(-1, row["keep"])
        self.vantage = read("vantage", np.float64).reshape(-1, row["dim"] + 1)
        self.near, self.far = read("near", np.float64), read("far", np.float64)
        self.leaves = len(self.vantage) + 1
        self.cuts = bounds(len(self.x), self.leaves)
        floats = self.x.astype(np.float64)
        self.norm = math.sqrt(float((floats * floats).sum(axis=1).max()))
        self.size = np.abs(floats).max(axis=0)

    def search(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query (its place), id and score of the k best rows (ties: smaller id) of each query whose
        score is in low..high, of its label or of other ones, without rows of its own id."""
        floats = q.astype(np.float64)
        square = (floats * floats).sum(axis=1)
        exact = float((np.abs(floats) @ self.size).max()) < 2.0**52
        slack = 1e-6 * np.sqrt(self.norm**2 + square)  # far more than rounding takes from a distance
        radius = lambda score: np.sqrt(np.maximum(self.norm**2 + square - 2 * score.astype(np.float64), 0.0))
        inner, outer = radius(high) - slack, radius(low) + slack
        least, most = self._leaf_distances(floats, square)
        start = np.where((least <= outer[:, None]) & (most >= inner[:, None]), np.maximum(least, inner[:, None]), np.inf)
        order = np.argsort(start, axis=1, kind="stable")
        start = np.take_along_axis(start, order, axis=1)
        best = [np.zeros(0, np.int64)] * 4  # query, score, id that ranks it, point
        kth = np.full(len(q), LEAST)
        limit, at, turn = outer.copy(), 0, 1
        while at < self.leaves:
            ahead = slice(at, at + turn)
            who, step = np.nonzero((start[:, ahead] <= limit[:, None]) & np.isfinite(start[:, ahead]))
            if not len(who):
                break
            leaf, found = order[:, ahead][who, step], [best]
            for one in np.unique(leaf):
                found.append(self._scored(one, who[leaf == one], q, floats, exact, own, label, low, high, same, k, kth))
            best = self._first([np.concatenate(c) for c in zip(*found)], k)
            full = np.flatnonzero(np.bincount(best[0], minlength=len(q)) >= k)
            kth[full] = best[1][np.searchsorted(best[0], full, side="right") - 1]
            limit[full] = np.minimum(outer, radius(kth) + slack)[full]
            at, turn = at + turn, 2 * turn
        return self._rows(best, own, k)

    def _leaf_distances(self, q: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each query's distance to the points of each leaf."""
        inner = len(self.vantage)
        to = np.sqrt(np.maximum((self.norm**2 + square)[:, None] - 2 * (q @ self.vantage[:, :-1].T), 0.0))
        least, most = np.zeros((len(q), 2 * inner + 1)), np.full((len(q), 2 * inner + 1), np.inf)
        for child in range(1, 2 * inner + 1):
            up = (child - 1) // 2
            least[:, child] = np.maximum(least[:, up], np.maximum(to[:, up] - self.far[child], self.near[child] - to[:, up]))
            most[:, child] = np.minimum(most[:, up], to[:, up] + self.far[child])
        return least[:, inner:], most[:, inner:]

    def _scored(self, leaf: int, who: np.ndarray, q: np.ndarray, floats: np.ndarray, exact: bool, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, kth: np.ndarray) -> list[np.ndarray]:
        a, b = self.cuts[leaf], self.cuts[leaf + 1]
        if exact:
            score = (floats[who] @ self.x[a:b].T.astype(np.float64)).astype(np.int64)
        else:
            whole = q[who].astype(object) @ self.x[a:b].T.astype(object)
            score = np.minimum(np.maximum(whole, LEAST), MOST).astype(np.int64)
        mine = self.ids[None, a:b, 0] == own[who, None]
        fits = ((self.label[None, a:b] == label[who, None]) == same) & (score >= low[who, None]) & (score <= high[who, None]) & ~(mine & (self.n_ids[None, a:b] == 1))
        rank = np.where(mine, self.ids[None, a:b, min(1, self.ids.shape[1] - 1)], self.ids[None, a:b, 0])
        least = kth[who]
        if b - a > k:
            least = np.maximum(least, np.partition(np.where(fits, score, LEAST), -k, axis=1)[:, -k])
        i, j = np.nonzero(fits & (score >= least[:, None]))
        return [who[i], score[i, j], rank[i, j], j + a]

    @staticmethod
    def _first(found: list[np.ndarray], k: int) -> list[np.ndarray]:
        """The k first of each query, by score and id."""
        by = np.lexsort((found[2], ~found[1], found[0]))
        found = [c[by] for c in found]
        nth = np.arange(len(by)) - np.searchsorted(found[0], found[0], side="left")
        return [c[nth < k] for c in found]

    def _rows(self, best: list[np.ndarray], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, score, _, point = best
        ids = self.ids[point]
        valid = (np.arange(ids.shape[1])[None, :] < self.n_ids[point, None]) & (ids != own[query, None])
        i, j = np.nonzero(valid)
        rows = self._first([query[i], score[i], ids[i, j]], k)
        return rows[0], rows[2], rows[1]


def forest(scratch: Scratch, rows: DataFrame, keep: int, parts: int, leaf: int = LEAF) -> DataFrame:
    """The written trees over points (``dim, x, label, ids``), one row each."""

    def build(part: pa.Table) -> pa.Table:
        dim = part["dim"][0].as_py()
        x = part["x"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order, vantage, near, far = grown(x, leaf)
        sizes = np.asarray(part["ids"].combine_chunks().value_lengths()).astype(np.int64)
        flat = part["ids"].combine_chunks().flatten().to_numpy()
        ids = np.zeros((len(x), keep), dtype=np.int64)
        ids[np.arange(keep)[None, :] < sizes[:, None]] = flat
        out = {"x": x[order], "label": part["label"].to_numpy()[order], "ids": ids[order], "n_ids": sizes[order], "vantage": vantage, "near": near, "far": far}
        return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([part["part"][0].as_py()], pa.int32()), "keep": pa.array([keep], pa.int32()), **{n: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for n, v in out.items()}})

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("x", "label"), F.lit(parts)).cast("int"))
    return scratch.table(dealt.groupBy("dim", "part").applyInArrow(build, TREE), "trees")


def asked(trees: DataFrame, queries: DataFrame, parts: int, groups: int, same: bool, k: int) -> DataFrame:
    """``ask, vec_id, score``: of each query (``ask, id, label, dim, x, low, high``) the k first rows of every tree."""
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = trees.select("*", each("group", groups))
    right = queries.select("*", each("part", parts), F.pmod(F.xxhash64("ask"), F.lit(groups)).cast("int").alias("group"))

    def find(part: pa.Table, asked: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if part.num_rows and asked.num_rows:
            tree, found = Tree(part.slice(0, 1).to_pylist()[0]), []
            x = asked["x"].combine_chunks().flatten().to_numpy().reshape(asked.num_rows, -1)
            ask, own, label, low, high = (asked[c].to_numpy() for c in ("ask", "id", "label", "low", "high"))
            for at in range(0, len(x), QUERIES):
                s = slice(at, at + QUERIES)
                query, ids, score = tree.search(x[s], own[s], label[s], low[s], high[s], same, k)
                found.append((ask[s][query], ids, score))
            out = [np.concatenate(c) for c in zip(*found)]
        return pa.table(dict(zip(("ask", "vec_id", "score"), out)))

    task = ["dim", "part", "group"]
    found = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(find, "ask long, vec_id long, score long")
    nth = F.row_number().over(W.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.  Anchors: rows whose
    id is divisible by ``every``; negatives score from ``low`` to ``high`` per cent of the positive."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "negatives")
    keep = max(positives, negatives) + 1
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")) & (F.size("v") > 0))
    rows = scratch.table(rows.select("id", "label", F.size("v").alias("dim"), integers(F.col("v")).alias("x")), "rows")
    # The limit applies before the shuffle, too, so a vector of a third of the rows moves a few times only.
    nth = F.dense_rank().over(W.partitionBy("dim", "x", "label").orderBy("id"))
    least = rows.withColumn("nth", nth).filter(F.col("nth") <= keep)
    points = scratch.table(least.groupBy("dim", "x", "label").agg(F.sort_array(F.collect_set("id")).alias("ids")), "points")
    anchors = rows.filter(F.col("id") % every == 0).distinct().withColumn("ask", F.monotonically_increasing_id())
    anchors = scratch.table(anchors.withColumn("low", F.lit(LEAST)).withColumn("high", F.lit(MOST)), "anchors")

    weight = lambda df: df.agg(F.coalesce(F.sum(8 * F.col("dim").cast("long")), F.lit(0))).first()[0]
    held, one = weight(points), weight(anchors)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(queries: int) -> int:
        """Groups of queries: trees move once a group, queries once a part."""
        return max(1, math.ceil(queries / HELD), math.ceil(math.sqrt(tasks * queries / max(1, held))))

    parts = max(1, math.ceil(held / HELD), math.ceil(tasks / dealt(one)))
    trees = forest(scratch, points, keep, parts, leaf)
    found = asked(trees, anchors, parts, dealt(one), True, positives)
    pairs = scratch.table(found.select("ask", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "pairs")
    # Exact bounds of a window: decimals hold what a long times a percentage comes to.
    score = F.col("positive_score").cast("decimal(28,0)")
    windows = pairs.select("ask", "positive_score", F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high")).distinct().filter("low <= high")
    windows = windows.withColumnRenamed("ask", "anchor").join(anchors.select(F.col("ask").alias("anchor"), "id", "label", "dim", "x"), "anchor").withColumn("ask", F.monotonically_increasing_id())
    windows = scratch.table(windows, "windows")
    hits = asked(trees, windows.select("ask", "id", "label", "dim", "x", "low", "high"), parts, dealt(weight(windows)), False, negatives)
    named = pairs.withColumnRenamed("ask", "anchor").join(windows.select("ask", "anchor", F.col("id").alias("anchor_id"), "positive_score"), ["anchor", "positive_score"])
    return named.join(hits, "ask").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
