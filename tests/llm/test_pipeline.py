"""Each stage of the pipeline held against brute force on its own input, and edge tables."""

from __future__ import annotations

import collections
import glob
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from bazaarlens.llm import mixing, packing, secrets, toxicity
from bazaarlens.llm.oracle import MIXING
from bazaarlens.llm.queries import TOKENIZER
from test_near_dedup import brute as near_groups


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of each stage, and the folders that hold them."""
    path = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = [(10**9 + k, f"Number {k} of the notes that were left: {' '.join(f'word{k}{j}' for j in range(60))} password = Qx7Rt2Yu5Io8Pa{k} and so on", "en", "planted", 0) for k in range(3)]
    docs.unionByName(spark.createDataFrame([*planted, (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{path}/documents")
    docs, out = spark.read.parquet(f"{path}/documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{path}/{name}")
        before, docs = docs, spark.read.parquet(f"{path}/{name}")
        out[name] = (before, docs, f"{path}/{name}")
        assert name == "packing" or docs.columns == before.columns
    return out


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def test_toxicity_goes_by_the_model(spark, sf, stages):
    before, after, _ = stages["toxicity"]
    scores = toxicity.score(before, toxicity.learn(before, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
    assert ids(after) == sorted((r["id"] for r in scores if r["score"] < 0.5), key=str)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["near_duplicates"]
    groups = near_groups([(r["doc_id"], r["text"]) for r in before.collect()])
    assert ids(after) == sorted((d for d, n, group in groups if d == group), key=str)


def test_live_secrets_are_masked_and_nothing_else_changes(stages):
    before, after, _ = stages["secrets"]
    spans = {r["id"]: [(s["start"], s["end"]) for s in r["spans"] or [] if s["verdict"] == "live"] for r in secrets.scan(before, repository=secrets.F.concat_ws("/", "source", "lang")).collect()}
    want = {}
    for r in before.collect():
        out, at = "", 0
        for start, end in sorted(spans[r["doc_id"]]):
            if start >= at:
                out += r["text"][at:start] + "[secret]"
            at = max(at, end)
        want[r["doc_id"]] = r["text"] and out + r["text"][at:]
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want and sum(map(len, spans.values())) >= 3


def test_the_mix_takes_what_sql_says(stages):
    before, after, _ = stages["mixing"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{stages['secrets'][2]}/*.parquet'")
    want = {r[0]: r[4] for r in con.sql(MIXING).fetchall() if r[4]}
    got = collections.Counter()
    for r in after.select("doc_id", mixing.words(after["text"]).alias("n")).collect():
        got[r["doc_id"]] += r["n"]
    assert set(got) == set(want) and all(abs(got[d] - want[d]) <= 0 for d in want)


def test_packing_holds_every_id_once_at_its_real_window(stages):
    before, after, _ = stages["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole = collections.Counter()
    for r in before.collect():
        whole.update([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    found, sizes = collections.Counter(), collections.Counter()
    for r in packing.pack(before, TOKENIZER).collect():
        found.update(np.frombuffer(r["ids"], "<u4").tolist())
        sizes[r["sequence_id"]] += r["length"]
    assert found == whole and max(sizes.values()) <= 2048
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values()) <= 0.02 * sum(sizes.values())
    assert after.count() == sum(1 for _ in packing.pack(before, TOKENIZER).toLocalIterator())


def test_run_gives_pieces(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_stages_take_edge_and_empty_tables(spark, sf, edge, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge, sf)
        assert out.count() > 0 and (name == "packing" or out.columns == edge.columns)
        assert stage(spark, empty, sf).count() == 0


def test_inputs_are_there(sf):
    assert {os.path.basename(p) for p in glob.glob(f"{sf}/*.parquet")} >= {"documents.parquet", "labels.parquet"}
