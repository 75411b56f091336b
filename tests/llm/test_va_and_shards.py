from __future__ import annotations

import numpy as np
import pytest

from bazaarlens.llm import shards, va_search
from bazaarlens.llm.scratch import Scratch


@pytest.mark.parametrize("cells", [2, 64])
def test_search_equals_brute_force(spark, cells):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(230, 6)).astype(np.float32)
    x[40:60] = x[7]
    x[100:104] = 0
    rows = [(i, x[i].tolist()) for i in range(len(x))] + [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (950, [float("inf")] * 6), (50, x[50].tolist()), (1000, [0.5, 0.25]), (1001, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("x", "x")
    got = {}
    for r in va_search.search(df, first=3, cells=cells).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ints = np.floor(256 * x.astype(np.float64)).astype(int)
    for q in range(0, 230, 50):
        s = ints @ ints[q]
        want = sorted((-v, i) for i, v in enumerate(s) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -v) for k, (v, i) in enumerate(want)]
    assert sorted(got[1000]) == [(1, 1001, 128 * 128 + 64 * 128)]
    assert set(got) == {0, 50, 100, 150, 200, 1000}
    assert va_search.search(df.limit(0)).count() == 0


def test_an_id_with_several_vectors_loses_no_result(spark):
    rows = [(50, [float(v), 0.0]) for v in (100, 90, 80, 70, 60, 55, 52)] + [(i, [float(i), 0.0]) for i in range(1, 12)] + [(50, [3.0, 0.0])]
    got = {}
    for r in va_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), first=2).collect():
        got.setdefault(r["score"] // r["vec_id"], []).append((r["query_id"], r["rank"], r["vec_id"]))
    assert len(got) == 8 and all(sorted(v) == [(50, n + 1, 11 - n) for n in range(5)] for v in got.values())


@pytest.mark.parametrize("scale", [1.0, 3e4, 5e12])
def test_large_components_lose_no_neighbour(spark, monkeypatch, scale):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(300, 5)) * scale).astype(np.float32)
    x[1::2] = x[::2] * (1 + rng.integers(-3, 3, size=(150, 5)) * 2.0**-20)  # neighbours that differ in few bits
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    ints = [[int(c) for c in row] for row in np.floor(256 * x.astype(np.float64))]
    got = {}
    for r in va_search.search(df, first=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, 300, 50):
        s = [sum(a * b for a, b in zip(row, ints[q])) for row in ints]
        want = sorted((-v, i) for i, v in enumerate(s) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, min(max(-v, -(2**63)), 2**63 - 1)) for k, (v, i) in enumerate(want)]


def test_running_bounds_keep_what_may_be_among_the_best():
    rng = np.random.default_rng(6)
    x = rng.integers(-500, 500, size=(9000, 4))
    grid = va_search.Grid([{"dim": 4, "at": a, "low": int(x[:, a].min()), "high": int(x[:, a].max())} for a in range(4)], 16)
    q = x[:7].astype(np.float64)
    i, j, most, least = va_search._bounded(grid, q, grid.cells(x), 6)
    exact = q @ x.T
    assert (most >= exact[i, j]).all() and (least <= exact[i, j]).all() and len(i) < 0.2 * exact.size
    for k in range(7):
        assert set(np.argsort(-exact[k], kind="stable")[:6]) <= set(j[i == k].tolist())


def test_store_appends_compacts_and_keeps_versions(spark, edge):
    store = shards.ShardStore(spark, Scratch(spark, "store").path, edge.schema)
    assert store.read().count() == 0 and store.compact() == 0
    first = store.append(edge, small_rows=2)
    second = store.append(edge.limit(3), small_rows=2)
    n = store.files().count()
    assert (first, second) == (1, 2) and n >= 6
    last = store.compact(target=1 << 20, factor=4)
    assert last > second and store.files().count() < n
    as_rows = lambda df: sorted(map(str, df.collect()))
    assert as_rows(store.read()) == as_rows(edge.union(edge.limit(3)))
    assert as_rows(store.read(first)) == as_rows(edge)
    store.vacuum()
    assert store.versions() == [last] and as_rows(store.read()) == as_rows(edge.union(edge.limit(3)))


def raced(store, after, other):
    """A writer that another one overtakes right after it has read the newest version."""
    newest, n = store.newest, [0]

    def read():
        version = newest()
        n[0] += 1
        if n[0] == after:
            other()
        return version

    store.newest = read
    return store


def test_no_commit_is_lost_and_none_doubled(spark, edge):
    root = Scratch(spark, "store").path
    new = lambda: shards.ShardStore(spark, root, edge.schema)
    rows = edge.count()
    new().append(edge, small_rows=2)
    assert raced(new(), 1, lambda: new().append(edge, small_rows=3)).append(edge) == 3
    assert new().read().count() == 3 * rows
    # Two compactions at once: the slower one gives up what it has merged.  Then one overtaken by an arrival.
    raced(new(), 2, lambda: new().compact(target=1 << 20)).compact(target=1 << 20)
    assert new().read().count() == 3 * rows
    new().append(edge, small_rows=2)
    raced(new(), 2, lambda: new().append(edge, small_rows=2)).compact(target=1 << 20)
    assert new().read().count() == 5 * rows
    # What a lost writer left goes after the period of grace, and not before.
    edge.write.parquet(f"{root}/data/lost")
    left = lambda: new()._listed(f"{root}/data").count()
    new().vacuum()
    live = new().files().count()
    assert left() > live
    new().vacuum(grace=-60)
    assert left() == live and new().read().count() == 5 * rows


def test_merged_files_are_runs_of_the_target(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id", "sha2(string(id), 256) AS text").repartition(12)
    store = shards.ShardStore(spark, Scratch(spark, "store").path, df.schema)
    store.append(df, small_rows=500)
    store.compact(target=400_000)
    sizes = [r["bytes"] for r in store.files().collect()]
    assert store.read().select("id").distinct().count() == store.read().count() == 60_000
    assert len(sizes) < 20 and max(sizes) < 700_000


def test_the_query_compacts(spark, sf, monkeypatch):
    from bazaarlens.llm.queries import QUERIES

    files = []
    compact = shards.ShardStore.compact

    def counted(self):
        before, version = self.files().count(), compact(self)
        files.append((before, self.files().count()))
        return version

    monkeypatch.setattr(shards.ShardStore, "compact", counted)
    rows = QUERIES["op4_tiered_compaction"](spark, sf).collect()
    assert all(r["settled"] for r in rows) and {r["arrival"] for r in rows} == {0, 1, 2, 3}
    assert all(after < before for before, after in files[1:])
    monkeypatch.setattr(shards.ShardStore, "compact", lambda self: self.newest())
    assert not all(r["settled"] for r in QUERIES["op4_tiered_compaction"](spark, sf).collect())
