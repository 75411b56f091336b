from __future__ import annotations

import re

import pytest

from bazaarlens.llm import mixing


def targets(sizes):
    """Water-filling by hand: cap, share the rest again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    cap, done, total = {s: 3 * sizes[s] for s in names}, {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in done]
        left, w = total - sum(done.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap[s]]
        if not over:
            return done | {s: left * weight[s] / w for s in free}
        done |= {s: cap[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 3000, "b": 100, None: 10, "c": 700}, {"a": 50}, {"x": 10, "y": 10, "z": 4000}])
def test_targets_and_takes(spark, tmp_path, sizes):
    rows, n = [], 0
    for source, size in sizes.items():
        while size:
            k = min(size, 1 + n * 7 % 61)
            rows.append((n, " ".join(["w"] * k), source))
            size, n = size - k, n + 1
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = mixing.mix(df, block=16).collect()
    want = targets(sizes)
    for source in sizes:
        own = [r for r in got if r["source"] == source]
        assert own[0]["target"] == pytest.approx(want[source]) and own[0]["source_size"] == sizes[source]
        assert abs(sum(r["taken"] for r in own) - want[source]) <= 1
    assert all(r["taken"] <= 3 * r["size"] for r in got) and len(got) == len(rows)
    assert sorted((r["id"], r["taken"]) for r in mixing.mix(df, block=16).collect()) == sorted((r["id"], r["taken"]) for r in got)
    taken = {r["id"]: r["taken"] for r in got}
    out = {}
    for r in mixing.mixed_documents(df, block=16).collect():
        out[r["doc_id"]] = out.get(r["doc_id"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert out == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("place", [0, 10, 20])
def test_a_source_far_under_one_block_gets_its_target(spark, tmp_path, place):
    names = [f"s{k:02}" for k in range(21)]
    rows = [(k, " ".join(["w"] * (2 if k == place else 50_000)), s) for k, s in enumerate(names)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(str(tmp_path / "d"))
    got = {r["id"]: r for r in mixing.mix(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got[place]["target"] == 6.0
    assert all(r["taken"] == int(r["target"]) for r in got.values())


def sources_file(spark, path, sizes):
    rows = [(n, " ".join(["w"] * (20 + n * 13 % 50)), s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_every_prefix_of_the_mix_holds_the_weights(spark, tmp_path):
    docs = sources_file(spark, tmp_path / "d", {"a": 300, "b": 200, "c": 400})
    rows = mixing.mix(docs, block=64).collect()
    share = {r["source"]: r["target"] for r in rows}
    total = sum(share.values())
    slots = sorted({t["slot"]: r["source"] for r in rows for t in r["takes"]}.items())
    # Slots in which a document is first read: nearly all of them, as documents are about as long as a block.
    seen = dict.fromkeys(share, 0)
    for n, (_, source) in enumerate(slots, 1):
        seen[source] += 1
        assert all(abs(seen[s] - n * share[s] / total) < 6 + 0.06 * n for s in share)
    out = [r["source"] for r in mixing.mixed_documents(docs, block=64).collect()]
    for at in range(0, len(out) - 150, 50):
        part = out[at : at + 150]
        assert all(abs(part.count(s) / 150 - share[s] / total) < 0.12 for s in share)


def test_constant_points_are_another_mix(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    docs = sources_file(spark, tmp_path / "d", {"a": 60, "b": 50, "c": 70})
    columns = lambda df: sorted(map(tuple, df.collect()))
    want = columns(mixing.digest(mixing.mix(docs, block=64)))
    for point in (0.999, 0.0, 7.0):
        monkeypatch.setattr(mixing, "_point", lambda j, point=point: F.lit(point) + 0 * j)
        got = columns(mixing.digest(mixing.mix(docs, block=64)))
        assert got != want and [r[:5] for r in got] == [r[:5] for r in want]  # the amounts hold, the order is gone


def test_edges(edge, empty):
    got = mixing.digest(mixing.mix(edge)).collect()
    assert len(got) == edge.count()
    assert {r["taken"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert mixing.digest(mixing.mix(empty)).count() == 0
    assert mixing.mixed_documents(edge).columns == edge.columns
