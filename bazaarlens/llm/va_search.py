"""Exact top-k inner products by vector-approximation files.

Vectors become integers floor(256 * x).  The approximation file holds one byte a component: its
cell among ``cells`` equal ones between the least and largest value of that component.  A scan of
the cells bounds each inner product from both sides; only candidates whose upper bound reaches the
k-th lower bound go on.  Then exact vectors are read: first the ``first`` best upper bounds of each
query, and after them exactly those candidates whose upper bound still reaches the k-th exact
score.  What was not read cannot be among the k.

Every query meets every vector, so parts of the file meet groups of queries, one pair a task.  A
task holds a part and a group of at most ``HELD`` bytes each and keeps a running k-th lower bound a
query over all its part, so it gives out little more than k candidates a query.  Groups and parts
are as few as memory and the number of tasks allow: while the queries fit ``HELD``, the file moves
a fixed number of times, however large it is.

Bounds are floating-point numbers, widened by what summing could lose where integers are not exact.

Equal vectors are one class with the k + 1 smallest ids, so a vector that a third of the rows
share is bounded and read once.

Defined results: a null vector and one with null, NaN or infinite components take no part;
vectors of another length than the query's are not compared with it; rows equal in id and
vector count once; several vectors of one id are queries each, and none meets rows of its own id; scores beyond a long rank as
they are and read as the nearest long; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.llm.scratch import Scratch

#: Cells of a component; bytes of approximations and of queries that a task holds; vectors and
#: queries whose bounds are computed at once.
CELLS, HELD, VECTORS, QUERIES = 64, 32 << 20, 2048, 256


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and largest value of each component, for each length of vectors."""
    for batch in batches:
        size = np.asarray(batch.column(0))
        for dim in np.unique(size):
            x = batch.column(1).filter(pa.array(size == dim)).flatten().to_numpy().reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in (np.full(dim, dim), np.arange(dim), x.min(axis=0), x.max(axis=0))]], names=["dim", "at", "low", "high"])


class Grid:
    """Cell bounds of each component, by length of vectors."""

    def __init__(self, rows: list, cells: int) -> None:
        self.low, self.step, self.most = {}, {}, {}
        for dim in {r["dim"] for r in rows}:
            own = sorted((r["at"], r["low"], r["high"]) for r in rows if r["dim"] == dim)
            self.low[dim] = np.array([r[1] for r in own], dtype=np.int64)
            self.step[dim] = np.array([(r[2] - r[1]) // cells + 1 for r in own], dtype=np.uint64)
            self.most[dim] = np.array([max(abs(r[1]), abs(r[2]) + (r[2] - r[1]) // cells + 1) for r in own], dtype=np.float64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((x.astype(np.uint64) - self.low[x.shape[1]].astype(np.uint64)) // self.step[x.shape[1]]).astype(np.uint8)

    def bounds(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest integer of each cell."""
        step = self.step[cells.shape[1]].astype(np.float64)
        low = self.low[cells.shape[1]].astype(np.float64) + cells * step
        return low, low + (step - 1)

    def slack(self, queries: np.ndarray) -> np.ndarray:
        """What the bounds of each query may be off: nothing while all sums are exact integers."""
        scale = np.abs(queries) @ self.most[queries.shape[1]]
        return np.where(scale < 2.0**52, 0.0, scale * (queries.shape[1] + 8) * 2.0**-50)

    def widest(self) -> float:
        """No inner product of these vectors is larger."""
        return max((float((m * m).sum()) for m in self.most.values()), default=0.0)


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(256.0) * x.cast("double")))


def usable(vector: Column) -> Column:
    """No null vector or component, all finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def _bounded(grid: Grid, q: np.ndarray, cells: np.ndarray, n: int, own: np.ndarray | None = None, only: np.ndarray | None = None, single: np.ndarray | None = None) -> list[np.ndarray]:
    """Query and vector (their places), upper and lower bound of what may be among each query's n
    best.  The n best lower bounds so far are kept, and what they rule out is dropped as they rise.
    A vector that a ``single`` id has (``only``) is no candidate of that id's queries (``own``)."""
    best, found = np.full((len(q), n), -np.inf), []
    plus, minus, slack = np.maximum(q, 0), np.minimum(q, 0), grid.slack(q)[:, None]
    for at in range(0, len(cells), VECTORS):
        low, high = grid.bounds(cells[at : at + VECTORS])
        most, least = plus @ high.T + minus @ low.T + slack, plus @ low.T + minus @ high.T - slack
        if own is not None:
            mine = (own[:, None] == only[None, at : at + VECTORS]) & single[None, at : at + VECTORS]
            most[mine], least[mine] = -np.inf, -np.inf
        best = np.partition(np.concatenate([best, least], axis=1), -n, axis=1)[:, -n:]
        i, j = np.nonzero((most >= best.min(axis=1)[:, None]) & (most > -np.inf))
        found.append([i, j + at, most[i, j], least[i, j]])
        if sum(len(f[0]) for f in found) > 1 << 20:
            found = [_reaching(found, best)]
    return _reaching(found, best)


def _reaching(found: list[list[np.ndarray]], best: np.ndarray) -> list[np.ndarray]:
    i, j, most, least = (np.concatenate(c) for c in zip(*found))
    still = most >= best.min(axis=1)[i]
    return [i[still], j[still], most[still], least[still]]


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5, first: int = 32, cells: int = CELLS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is divisible by ``every``."""
    scratch = Scratch(vectors.sparkSession, "va")
    usable_rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = scratch.table(usable_rows.select("id", F.size("v").cast("long").alias("dim"), integers(F.col("v")).alias("x")), "rows")
    # A class for each distinct vector, with the k + 1 smallest ids, of which one may be the query's own: the limit applies before the shuffle, too.
    rank = F.row_number().over(W.partitionBy("dim", "x").orderBy("id"))
    least = rows.groupBy("dim", "x", "id").agg(F.lit(1)).withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    classes = least.groupBy("dim", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = scratch.table(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    # Several vectors of one id are queries each.
    queries = scratch.numbered(rows.filter(F.col("id") % every == 0).select(F.col("id").alias("query"), "dim", "x").distinct(), "ask", "queries")
    grid = Grid(rows.filter("dim > 0").select("dim", "x").mapInArrow(_ranges, "dim long, at long, low long, high long").groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect(), cells)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(1))
            for dim in np.unique(size[size > 0]):
                own = batch.filter(pa.array(size == dim))
                x = own.column(2).flatten().to_numpy().reshape(-1, dim)
                keys, only, single = (own.column(c).to_numpy(zero_copy_only=False) for c in (0, 3, 4))
                yield pa.RecordBatch.from_arrays([pa.array([int(dim)]), pa.array([int(keys[0])]), *[pa.array([b.tobytes()]) for b in (keys.astype(np.int64), grid.cells(x), only.astype(np.int64), single.astype(bool))]], names=["dim", "block", "keys", "cells", "only", "single"])

    coded = classes.select("key", "dim", "x", F.get("ids", F.lit(0)).alias("only"), (F.size("ids") == 1).alias("single"))
    file = scratch.table(coded.mapInArrow(approximate, "dim long, block long, keys binary, cells binary, only binary, single binary"), "approximations")
    held, asked = (df.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0] for df, n in ((file, F.length("cells")), (queries, 8 * F.col("dim"))))
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The file moves once a group and the queries once a part: least for this ratio of the two.
    groups = max(1, math.ceil(asked / HELD), math.ceil(math.sqrt(tasks * asked / max(1, held))))
    parts = max(1, math.ceil(held / HELD), math.ceil(tasks / groups))
    each = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = file.select("dim", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), each("group", groups), "keys", "cells", "only", "single")
    right = queries.select("dim", each("part", parts), F.pmod(F.xxhash64("ask"), F.lit(groups)).cast("int").alias("group"), "ask", "query", "x")

    def bound(file: pa.Table, asked: pa.Table) -> pa.Table:
        names, found = ["ask", "key", "most", "least"], []
        if file.num_rows and asked.num_rows:
            dim = file["dim"][0].as_py()
            keys = np.frombuffer(b"".join(file["keys"].to_pylist()), np.int64)
            cells = np.frombuffer(b"".join(file["cells"].to_pylist()), np.uint8).reshape(-1, dim)
            q = asked["x"].combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
            only, single = np.frombuffer(b"".join(file["only"].to_pylist()), np.int64), np.frombuffer(b"".join(file["single"].to_pylist()), bool)
            ids, own = asked["ask"].to_numpy(), asked["query"].to_numpy()
            for at in range(0, len(q), QUERIES):
                found.append(_bounded(grid, q[at : at + QUERIES], cells, k, own[at : at + QUERIES], only, single))
                found[-1] = (ids[at : at + QUERIES][found[-1][0]], keys[found[-1][1]], *found[-1][2:])
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2
        return pa.table(dict(zip(names, columns)))

    task = ["dim", "part", "group"]
    bounds = scratch.table(left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(bound, "ask long, key long, most double, least double"), "bounds")
    by = lambda c: W.partitionBy("ask").orderBy(F.desc(c), "key")
    kth = lambda df, c: df.withColumn("n", F.row_number().over(by(c))).filter(F.col("n") == k).select("ask", F.col(c).alias("limit"))
    reach = lambda df, limits: df.join(limits, "ask", "left").filter(F.col("limit").isNull() | (F.col("most") >= F.col("limit"))).drop("limit")
    able = scratch.table(reach(bounds, kth(bounds, "least")), "able")

    def exact(pairs: DataFrame) -> DataFrame:
        both = pairs.join(classes.select("key", F.col("x").alias("y"), "ids"), "key").join(queries.select("ask", "query", "x"), "ask")
        kind = "decimal(38,0)" if grid.widest() >= 2.0**62 else "bigint"  # else 64 bits hold every sum
        products = F.zip_with("x", "y", lambda a, b: (a.cast(kind) * b.cast(kind)).cast(kind))
        score = F.aggregate(products, F.lit(0).cast(kind), lambda s, p: (s + p).cast(kind))
        return both.select("ask", "query", "key", "ids", score.alias("score"))

    ranked = able.withColumn("n", F.row_number().over(by("most")))
    early = scratch.table(exact(ranked.filter(F.col("n") <= first).drop("n")), "early")
    late = exact(reach(ranked.filter(F.col("n") > first).drop("n"), kth(early, "score")))
    found = early.unionByName(late).select("ask", "query", F.explode("ids").alias("vec_id"), "score").filter("query <> vec_id")
    order = W.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", F.greatest(F.least("score", F.lit(2**63 - 1)), F.lit(-(2**63))).cast("long").alias("score"))
