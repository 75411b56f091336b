"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths, in numpy over slices of Arrow batches (1 MB of
text or one row, so memory does not grow with a batch of long texts), mark the n-grams that occur
twice or more in a text; the share of the text's word characters inside marked n-grams, and inside
lines that repeat an earlier line, is held against a limit for each length.  Longer n-grams have
lower limits, as chance repeats of them are rarer.

Defined results: a null or empty text has zero counts and fails (it has under 50 words); equal
lines are those with equal code points between newlines; repeated rows give equal results; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.text import mix, prefix_hash, utf8, window_hashes, word_hashes
from bazaarlens.llm.tokens import slices

#: n-gram length in words: largest share of word characters in repeated n-grams that passes.
LIMITS = {5: 0.30, 6: 0.28, 8: 0.24, 10: 0.20}
LINE_LIMIT = 0.30
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_coverage double, gram_coverage array<double>"


def _sum_rows(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of ``values[rows[i]:rows[i + 1]]`` for each i."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[rows[1:]] - sums[rows[:-1]]


def _repeated(words: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its own row holds twice or more."""
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    if len(words) >= n:
        windows, doc = window_hashes(words, n), np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        starts = np.flatnonzero(doc[: len(windows)] == doc[n - 1 :])  # windows within one row
        keys = mix(windows[starts] + doc[starts].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(starts), dtype=bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        at = starts[twice]
        np.add.at(inside, at, 1)
        np.subtract.at(inside, at + n, 1)
    return np.cumsum(inside)[:-1] > 0


def measure(texts: pa.Array, lengths: tuple[int, ...] = tuple(LIMITS)) -> list[np.ndarray]:
    """The columns of SCHEMA for a batch of texts; the last has a row for each length."""
    data, offsets = utf8(texts)
    words, starts, ends, rows = word_hashes(data, offsets)
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    chars = point[ends] - point[starts]
    word_chars = _sum_rows(chars, rows)
    n_symbols = _sum_rows(SYMBOLS[data], offsets)

    # Lines with a word: their bounds, their hash and the characters of their words.
    newline = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(offsets, newline, side="right") - 1
    has_text = offsets[1:] > offsets[:-1]
    line_start = np.concatenate((offsets[:-1][has_text], newline + 1))
    line_doc = np.concatenate((np.flatnonzero(has_text), doc_of))
    order = np.argsort(line_start * 2 + (np.arange(len(line_start)) < has_text.sum()), kind="stable")
    line_start, line_doc = line_start[order], line_doc[order]
    line_end = np.minimum(np.concatenate((line_start[1:] - 1, [len(data)])) if len(line_start) else line_start, offsets[line_doc + 1])
    last = np.concatenate((line_doc[1:] != line_doc[:-1], [True])) if len(line_doc) else np.zeros(0, bool)
    line_end = np.where(last, offsets[line_doc + 1], line_end)
    first_word = np.searchsorted(starts, np.stack([line_start, line_end]))
    sums, inverse = prefix_hash(data)
    line_chars = np.concatenate(([0], np.cumsum(chars)))
    line_chars = line_chars[first_word[1]] - line_chars[first_word[0]]
    held = first_word[1] > first_word[0]
    key = mix((sums[line_end] - sums[line_start]) * inverse[line_start] + mix(line_doc.astype(np.uint64) + np.uint64(77)))[held]
    doc, weight = line_doc[held], line_chars[held]
    by_key = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[by_key[1:]] = key[by_key][1:] == key[by_key][:-1]
    n = len(offsets) - 1
    n_dup_lines = np.bincount(doc, weights=again, minlength=n).astype(np.int64)
    dup_chars = np.bincount(doc, weights=again * weight, minlength=n)

    whole = np.maximum(word_chars, 1)
    n_repeat = _sum_rows(_repeated(words, rows, 3), rows)
    grams = np.stack([_sum_rows(_repeated(words, rows, k) * chars, rows) / whole for k in lengths], axis=1)
    return [np.diff(rows), word_chars, n_symbols, n_dup_lines, n_repeat, dup_chars / whole, grams]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row per document: id, counts, the coverages, ``base_failed`` and ``kept``."""
    lengths = tuple(limits)

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1):
                *columns, grams = measure(piece.column(1), lengths)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(grams.ravel()), len(lengths)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, columns), flat], names=["id", *NAMES])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(batches, f"id {kind}, {SCHEMA}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    over = F.exists(F.arrays_zip(F.col("gram_coverage").alias("c"), F.array(*map(F.lit, limits.values())).alias("limit")), lambda x: x["c"] > x["limit"])
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over & (F.col("line_coverage") <= line_limit))


NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def digest(scored: DataFrame) -> DataFrame:
    return scored.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.round("line_coverage", 6).alias("line_coverage"), F.round(F.array_max("gram_coverage"), 6).alias("gram_coverage"))
