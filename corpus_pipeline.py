"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, live
credentials are masked, sources are mixed to their target weights, and the mix is packed.

Each stage takes the documents that its predecessor kept and returns documents of the same
columns; the last returns the pieces of packed sequences.  Stages are written and read again
between one another, so row numbers within a stage are those of fixed files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm import mixing, near_dedup, packing, secrets, toxicity
from bazaarlens.llm.queries import TOKENIZER, table
from bazaarlens.llm.scratch import Scratch


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model does not call toxic."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the smallest id."""
    return near_dedup.deduplicated(docs)


def without_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, credentials that only one owner carries and that look random masked."""
    return secrets.redact(docs, length_col="n_chars", repository=F.concat_ws("/", "source", "lang"))


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes."""
    return mixing.mixed_documents(docs, length_col="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences into which the mix is packed."""
    return packing.digest(packing.pack(docs, TOKENIZER))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_live_secrets),
    ("mixing", mixed_to_weights),
    ("packing", packed),
]

#: A fitted model and a tokenizer library are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
