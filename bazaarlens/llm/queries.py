"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import alignment, fingerprints, grammar, hard_negatives, mixing, near_dedup, packing, repetition, secrets, shards, suffix_dedup, toxicity, va_search
from bazaarlens.llm.scratch import Scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder; Python workers get this repository on their path, and
    Arrow batches small enough that a few of them fit beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(":"):
        environment["PYTHONPATH"] = ":".join(filter(None, [root, environment.get("PYTHONPATH", "")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents"), repository=F.concat_ws("/", "source", "lang")))


def op2_noisy_or_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.digest(toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))))


def op3_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op4_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in four arrivals (half, a quarter and two eighths of the ids), compacted after each two."""
    i = F.col("doc_id")
    arrival = F.when(i % 2 == 0, 0).when(i % 4 == 1, 1).when(i % 8 == 3, 2).otherwise(3)
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, Scratch(spark, "store").path, docs.schema)
    for n in range(4):
        store.append(docs.filter(arrival == n))
        if n % 2:
            store.compact()
            store.vacuum()
    columns = ["doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), arrival.alias("arrival")]
    rows = store.read().select(*columns, F.col("_metadata.file_path").alias("path"))
    to_merge = store.pending().select("path", F.lit(False).alias("settled"))
    return rows.join(to_merge, "path", "left").withColumn("settled", F.coalesce("settled", F.lit(True))).drop("path")


def op5_grammar_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = grammar.write_shards(table(spark, sf_dir, "documents"), TOKENIZER, Scratch(spark, "shards"))
    return grammar.digest(grammar.read_shards(shards))


def op6_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), TOKENIZER))


def op7_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.digest(near_dedup.groups(table(spark, sf_dir, "documents")))


def op8_approximation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.search(table(spark, sf_dir, "embeddings"))


def op9_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.digest(repetition.score(table(spark, sf_dir, "documents")))


def op10_radix_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.removed(table(spark, sf_dir, "documents")))


def op11_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.edited_pairs(table(spark, sf_dir, "documents")))


def op12_vantage_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(alignment.align(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES).documents)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_ownership, op2_noisy_or_toxicity, op3_source_schedule, op4_tiered_compaction, op5_grammar_shards, op6_minimum_bin_slack, op7_minhash_groups, op8_approximation_search, op9_repetition_coverage, op10_radix_suffix_dedup,
                                op11_one_permutation_fingerprints, op12_vantage_hard_negatives, op13_tokenizer_alignment)
}
