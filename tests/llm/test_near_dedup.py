from __future__ import annotations

import random
import re

import pytest

from bazaarlens.llm import near_dedup
from bazaarlens.llm.components import connected_components
from bazaarlens.llm.scratch import Scratch


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    own = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 75 * len(own[i] | own[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(own[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for family in range(12):
        base = [word() for _ in range(rng.choice([6, 40, 120, 300]))]
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((rng.randrange(10_000) * 100 + len(rows), " ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper()))
            if rng.random() < 0.2:
                rows.append((rng.randrange(10_000) * 100 + len(rows), "  " + "\n".join(copy)))
    return rows


@pytest.mark.parametrize(("block", "large"), [(512, 48), (4, 100), (4, 1), (512, 2)])
def test_groups_equal_brute_force(spark, tmp_path, corpus, monkeypatch, block, large):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "LARGE", large)
    spark.createDataFrame(corpus, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = near_dedup.digest(near_dedup.groups(docs)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(corpus))
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert {r["doc_id"] for r in near_dedup.deduplicated(docs).collect()} == kept


@pytest.mark.parametrize("large", [48, 1])
def test_pairs_that_no_centre_links(spark, tmp_path, monkeypatch, large):
    monkeypatch.setattr(near_dedup, "CENTRES", 0)  # all pairs are left to the second round
    monkeypatch.setattr(near_dedup, "LARGE", large)
    rng, rows = random.Random(5), []
    for k in range(1500):
        base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        rows.append((2 * k, " ".join(base)))
        for at in (20, 60, 100):
            base[at] = "other"  # 101 of 131 shingles stay
        rows.append((2 * k + 1, " ".join(base)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.digest(near_dedup.groups(spark.read.parquet(str(tmp_path / "d")))).collect()}
    assert [k for k in range(3000) if got[k] != k - k % 2] == []


def test_edges(edge, empty):
    got = near_dedup.digest(near_dedup.groups(edge)).collect()
    want = brute([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(want, key=str)
    assert near_dedup.digest(near_dedup.groups(empty)).count() == 0
    assert near_dedup.deduplicated(edge).columns == edge.columns


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100, 102: 100}
