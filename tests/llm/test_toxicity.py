from __future__ import annotations

import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bazaarlens.llm import toxicity


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 12))).capitalize() + "." for _ in range(rng.randint(1, 12))]
        if bad := i % 5 == 0:
            at = rng.randrange(len(sentences))
            sentences[at] = "You are a " + rng.choice(["vermin", "dimwit", "scumling"]) + " " + sentences[at]
        docs.append((i, " ".join(sentences)))
        labels.append((i, int(bad)))
    path = str(tmp_path_factory.mktemp("tox"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path + "/d")
    return spark.read.parquet(path + "/d"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(docs), dict(labels)


def test_held_out_accuracy_and_sentences(corpus):
    docs, labels, texts, truth = corpus
    model = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, model)
    got = {r["doc_id"]: r for r in toxicity.digest(scored).collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert len(held) > 80 and all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["predicted"] == truth[i] for i in held) >= 0.97 * len(held)
    for r in scored.filter(F.size("offending") > 0).collect():
        worst = texts[r["id"]][r["offending"][0]["start"] : r["offending"][0]["end"]]
        if truth[r["id"]]:
            assert any(w in worst for w in ("vermin", "dimwit", "scumling"))


def test_scores_equal_brute_force(spark, corpus):
    docs, labels, texts, _ = corpus
    model = toxicity.learn(docs, labels)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))

    def sentences(text):
        at = 0
        for piece in re.split(r"(?<=[.!?\n])", text):
            words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", piece)
            if words:
                own = [b for w in words for b in toxicity.features(pa.array([w]))[0][0].tolist()]
                yield at, at + len(piece), model.bias + sum(weight.get(b, 0.0) for b in own)
            at += len(piece)

    odd = [None, "", "...", "no end", "One. Two! Three?\nFour", "é vermin. ß VERMIN! scumling"]
    some = {i: texts[i] for i in range(0, 60)} | {1000 + k: t for k, t in enumerate(odd)}
    scored = toxicity.score(spark.createDataFrame(list(some.items()), "doc_id long, text string"), model).collect()
    for r in scored:
        each = list(sentences(some[r["id"]] or ""))
        clean = math.prod(1 - 1 / (1 + math.exp(-z)) for *_, z in each)
        assert r["score"] == pytest.approx(1 - clean, abs=1e-9)
        assert sorted((s["start"], s["end"]) for s in r["offending"]) == [(a, b) for a, b, z in each if z >= 0]


def test_sample_bound(corpus):
    docs, labels, _, truth = corpus
    got = toxicity.digest(toxicity.score(docs, toxicity.learn(docs, labels, sample=250))).collect()
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in got) >= 0.9 * len(got)


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = toxicity.learn(edge, labels)
    assert toxicity.digest(toxicity.score(edge, model)).count() == edge.count()
    assert toxicity.digest(toxicity.score(empty, model)).count() == 0
    assert toxicity.learn(empty, labels.limit(0)).constant == 0.0
