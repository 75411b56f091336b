from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import hard_negatives
from bazaarlens.llm.queries import QUERIES


def clamp(v):
    return min(max(v, -(2**63)), 2**63 - 1)


def brute(rows, every=100, positives=5, negatives=10):
    """rows: (id, label, vector), distinct, all usable."""
    rows = [(i, y, [int(np.clip(np.floor(256 * float(c)), -(2.0**63), 2.0**63 - 1024)) for c in v]) for i, y, v in rows]
    out = []
    for a, y, q in rows:
        if a % every:
            continue
        scored = [(clamp(sum(s * t for s, t in zip(q, x))), i, z) for i, z, x in rows if i != a and len(x) == len(q)]
        for ps, p, _ in sorted((r for r in scored if r[2] == y), key=lambda r: (-r[0], r[1]))[:positives]:
            fits = sorted((r for r in scored if r[2] != y and 30 * ps <= 100 * r[0] <= 90 * ps), key=lambda r: (-r[0], r[1]))[:negatives]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("id", F.lit("x")).withColumn("part", F.lit(1)).repartition(3)
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("label"), **options).collect())


@pytest.mark.parametrize("scale,leaf", [(1.0, 8), (1.0, 256), (3e4, 16), (2e6, 16)])
def test_negatives_equal_brute_force(spark, scale, leaf):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(420, 6)) + 0.7
    x[40:90] = x[100]  # equal vectors
    x[200:204] = 0
    rows = [(i, int(rng.integers(0, 3)), (v * scale).astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(100, 1, rows[7][2]), (100, 1, rows[9][2]), (55, 2, rows[8][2])]  # ids with several vectors
    rows += [(1000, 1, [0.5, 0.25]), (1001, 1, [0.5, 0.5]), (1002, 2, [0.25, 0.25])]
    odd = [(1100, None, [1.0] * 6), (1200, 1, None), (1300, 1, [1.0, None] * 3), (1400, 1, [float("nan")] * 6), (1500, 1, [float("inf")] * 6), (1600, 1, []), (None, 1, [1.0] * 6)]
    got = mined(spark, rows + odd + rows[:50], leaf=leaf)
    assert len(got) > 100 and got == brute(rows)


def test_no_anchor_no_positive_no_rows(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == [] and mined(spark, [(100, 1, [1.0]), (2, 2, [1.0])]) == []


def test_query_equals_brute_force(spark, sf):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    out = QUERIES["op12_vantage_hard_negatives"](spark, sf)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_far_leaves_are_not_visited(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(-3000, 3000, size=(40, 3))[rng.integers(0, 40, 8000)] + rng.integers(-40, 40, size=(8000, 3))
    order, vantage, near, far = hard_negatives.grown(x, 64)
    assert sorted(order.tolist()) == list(range(8000))
    tree = hard_negatives.Tree({"dim": 3, "keep": 1, "x": x[order].tobytes(), "label": np.zeros(8000, np.int64).tobytes(), "ids": order[:, None].astype(np.int64).tobytes(), "n_ids": np.ones(8000, np.int64).tobytes(), "vantage": vantage.tobytes(), "near": near.tobytes(), "far": far.tobytes()})
    q, visited, scored = x[:20], [], tree._scored
    monkeypatch.setattr(tree, "_scored", lambda leaf, who, *rest: visited.append(len(who)) or scored(leaf, who, *rest))
    least = np.full(20, -(2**63))
    high = (x @ q.T).max(axis=0) * 6 // 10
    query, ids, score = tree.search(q, np.arange(20), np.ones(20, np.int64), least, high, False, 5)
    for k in range(20):
        s = x @ q[k]
        want = sorted((-v, i) for i, v in enumerate(s.tolist()) if v <= high[k] and i != k)[:5]
        assert [(-v, i) for v, i in zip(score[query == k].tolist(), ids[query == k].tolist())] == want
    assert sum(visited) < 0.4 * 20 * tree.leaves
