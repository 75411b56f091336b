"""Toxicity by multiple-instance learning.

Labels are known for whole documents only.  A document is a bag of sentences; a sentence has
probability sigmoid(bias + sum of the weights of its words' features), and a document is toxic
if any sentence is: 1 - product of (1 - sentence probability), the noisy-or.  Weights are fitted
to document labels through that noisy-or, so the model learns which sentences offend and can
point at them.  Features are hashed: each word, and its first 4, 5, 6 and 8 bytes, A-Z lowered.

Learning reads a bounded sample of the labelled documents outside the held-out fold (``sample``
documents, chosen by hash); Spark counts features over it and keeps the ``features`` that lean
most to one label, and only these reach the fit.  Scoring reads every whole text.

Defined results: a null or empty text has no sentence that offends and gets the score of an
empty bag; a document labelled more than once counts as toxic if any label says so, null labels
are ignored; of rows that share a labelled id one is learnt from; a null id is in the held-out
fold; without both kinds of labels every score is the share of toxic labels (0 without labels);
repeated rows are scored each; an empty table gives no rows; only the named columns are read, and
of them only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.scratch import Scratch
from bazaarlens.llm.text import LOWER_VALUE, mix, prefix_hash, utf8
from bazaarlens.llm.tokens import slices

SAMPLE, FEATURES, BITS, PREFIXES = 20_000, 4096, 20, (4, 5, 6, 8)
#: Standard deviations between a feature's shares of toxic and of clean documents, at least.
DEVIATIONS = 5.0
#: Bytes that end a sentence, and those inside words: letters, digits and all beyond ASCII.
ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))
WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


@dataclass(frozen=True)
class Model:
    """Feature buckets (sorted), their weights, the bias, and the score of all documents if
    nothing could be learnt (else None)."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None


def _runs(inside: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of true values; a run does not go on where ``first`` is true."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return starts, np.flatnonzero(inside & (~after | first[1:])) + 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets (a row a word), the sentence of each word, the document, start and end
    (bytes within all texts) of each sentence.  Only sentences with a word count."""
    data, offsets = utf8(texts)
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    starts, ends = _runs(WORD[data], first)
    sums, inverse = prefix_hash(data, LOWER_VALUE)
    columns = []
    for k, stop in enumerate([ends, *[np.minimum(starts + p, ends) for p in PREFIXES]]):
        hashes = mix((sums[stop] - sums[starts]) * inverse[starts] + np.uint64(k))
        columns.append((hashes >> np.uint64(64 - BITS)).astype(np.int64))
    # A sentence starts at a document's start and after each sentence end.
    breaks = np.union1d(offsets, np.flatnonzero(ENDS[data]) + 1)
    place = np.searchsorted(breaks, starts, side="right") - 1
    kept, sentence = np.unique(place, return_inverse=True)
    begin = breaks[kept]
    end = np.append(breaks, len(data))[kept + 1] if len(kept) else begin
    doc = np.searchsorted(offsets, begin, side="right") - 1
    return np.stack(columns, axis=1) if len(starts) else np.zeros((0, 1 + len(PREFIXES)), np.int64), sentence, doc, begin, np.minimum(end, offsets[doc + 1])


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch of (text, toxic): in how many toxic and clean documents each bucket occurs."""
    for batch in batches:
        for part in slices(batch, 0):
            buckets, sentence, doc, *_ = features(part.column(0))
            toxic = np.asarray(part.column(1)).astype(bool)
            keys = np.unique((doc[sentence][:, None] << BITS | buckets).ravel())
            own, side = keys & ((1 << BITS) - 1), toxic[keys >> BITS]
            both = np.stack([np.bincount(own[side], minlength=1 << BITS), np.bincount(own[~side], minlength=1 << BITS)])
            held = np.flatnonzero(both.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(both[0, held]), pa.array(both[1, held])], names=["bucket", "toxic", "clean"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, keep: int = FEATURES) -> Model:
    """Fit a model to the labelled documents outside the held-out fold."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).dropna().filter(fold(F.col("id")) != 0)
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    count = known.count()
    if count > sample:  # a hash range that holds about ``sample`` of them
        known = known.filter(F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1)) < int(sample / count * (1 << 30)))
    known = F.broadcast(known)  # bounded by ``sample``
    chosen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(known, "id")
    chosen = chosen.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), (F.max("toxic") > 0).alias("toxic")).select("text", "toxic")
    chosen = Scratch(docs.sparkSession, "toxicity").table(chosen, "chosen")  # read three times
    totals = chosen.groupBy().agg(F.count_if(F.col("toxic")).alias("toxic"), F.count("*").alias("all")).first()
    positive, negative = totals["toxic"], totals["all"] - totals["toxic"]
    if not positive or not negative:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, positive / max(1, totals["all"]))
    counts = chosen.mapInArrow(_count, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p, q = (F.col("toxic") + 0.5) / (positive + 1), (F.col("clean") + 0.5) / (negative + 1)
    # Only what is far from chance, given how many features there are, and not the habit of a few copies.
    pooled = (F.col("toxic") + F.col("clean") + 1) / (positive + negative + 2)
    far = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / positive + 1 / negative)) >= DEVIATIONS
    held = counts.filter(far & ((F.col("toxic") >= max(4, positive // 100)) | (F.col("clean") >= max(4, negative // 100))))
    held = held.filter(F.abs(F.log(p / q)) > 1).orderBy(F.desc(F.abs((p - q) * F.log(p / q))), "bucket").limit(keep)
    buckets = np.sort(np.array([r["bucket"] for r in held.select("bucket").collect()], dtype=np.int64))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                own, sentence, doc, *_ = features(part.column(0))
                at = _index(buckets, own)
                row, column = np.nonzero(at >= 0)
                pairs = np.stack([sentence[row], at[row, column]], axis=1)
                bounds = np.searchsorted(doc[pairs[:, 0]], np.arange(part.num_rows + 1))
                size = np.bincount(doc, minlength=part.num_rows)
                held = [np.unique(pairs[a:b], axis=0).astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(size), pa.array(held, pa.binary())], names=["toxic", "sentences", "pairs"])

    rows = chosen.mapInArrow(bags, "toxic boolean, sentences long, pairs binary").collect()
    return fit(buckets, rows)


def _index(buckets: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Place of each bucket among the model's, -1 if it is not there."""
    table = np.full(1 << BITS, -1, dtype=np.int64)
    table[buckets] = np.arange(len(buckets))
    return table[own]


def fit(buckets: np.ndarray, bags: list, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Weights by Adam on the noisy-or likelihood; ``bags``: (toxic, sentences, pairs of
    sentence and feature)."""
    sentence, feature, owner, plain, at = [], [], [], np.zeros(len(bags)), 0
    for k, (_, n, pairs) in enumerate(bags):
        pairs = np.frombuffer(pairs, np.int32).reshape(-1, 2)
        own, place = np.unique(pairs[:, 0], return_inverse=True)
        sentence.append(place + at)
        feature.append(pairs[:, 1])
        owner.append(np.full(len(own), k))
        plain[k] = n - len(own)  # sentences without a feature all have the bias alone
        at += len(own)
    sentence, feature, owner = (np.concatenate(x).astype(np.int64) for x in (sentence, feature, owner))
    toxic = np.array([bool(t) for t, *_ in bags])
    x = np.zeros(len(buckets) + 1)
    x[-1] = -5.0
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        z = x[-1] + np.bincount(sentence, weights=x[feature], minlength=at)
        p, base = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-x[-1]))
        clean = np.bincount(owner, weights=-np.logaddexp(0, z), minlength=len(toxic)) - plain * np.logaddexp(0, x[-1])  # log of the product
        odds = np.where(toxic, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0) / len(toxic)
        slope = odds[owner] * p
        g = np.append(np.bincount(feature, weights=slope[sentence], minlength=len(buckets)), slope.sum() + (odds * plain * base).sum()) + decay * np.append(x[:-1], 0) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    return Model(buckets, x[:-1], float(x[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, ``keep`` columns as ``k_<name>``, score, and the sentences that
    offend, the worst first: start and end (code points) and score of each with 0.5 or more."""
    weights = np.zeros(1 << BITS)
    weights[model.buckets] = model.weights
    kinds = ", ".join(f"k_{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {kinds + ', ' if keep else ''}score double, offending array<struct<start:int,end:int,score:double>>"
    names = ["id", *[f"k_{c}" for c in keep], "score", "offending"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1)
                own, sentence, doc, begin, end = features(texts)
                z = model.bias + np.bincount(sentence, weights=weights[own].sum(axis=1), minlength=len(doc))
                clean = np.bincount(doc, weights=-np.logaddexp(0, z), minlength=part.num_rows)
                scores = -np.expm1(clean) if model.constant is None else np.full(part.num_rows, model.constant)
                found: list[list] = [[] for _ in range(part.num_rows)]
                if model.constant is None and (z >= 0).any():
                    data, offsets = utf8(texts)
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    for s in np.flatnonzero(z >= 0)[np.argsort(-z[z >= 0], kind="stable")]:
                        d, zero = doc[s], points[offsets[doc[s]]]
                        found[d].append({"start": int(points[begin[s]] - zero), "end": int(points[end[s]] - zero), "score": float(1 / (1 + np.exp(-z[s])))})
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], pa.array(scores), pa.array(found, span)], names=names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"k_{c}") for c in keep]).mapInArrow(batches, schema)


def digest(scored: DataFrame) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), (fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                         F.size("offending").alias("n_offending"))


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the model, learnt on them and ``labels``, does not call toxic."""
    columns = docs.columns
    scored = score(docs, learn(docs, labels, id_col, text_col), id_col, text_col, keep=tuple(columns))
    return scored.filter("score < 0.5").select(*[F.col(f"k_{c}").alias(c) for c in columns])
