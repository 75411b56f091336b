"""Document fingerprints by one-permutation MinHash.

Each distinct run of five words (A-Z lowered) is hashed once; the hash's high bits name one of
``BINS`` bins, and a bin keeps its least hash.  Optimal densification fills an empty bin from the
first bin that is not empty in a fixed pseudo-random order of its own, so two texts whose filled
bins agree copy from the same ones.  What is stored is the low ``BITS`` bits of every bin, packed;
a copied value is hashed with its bin first, so that copies do not agree by chance all at once.
Two bins agree by chance with probability 2**-BITS, and ``likeness`` takes that out of the share of
equal bins: an unbiased estimate of the Jaccard similarity, cut to 0..1.

``edited_pairs`` holds each text against the next document's and against an edited text of its own.
The next document is found by one range shuffle by id: tasks hold sorted ranges, every task gives
out its first and last row, and the last ones meet the next range's first in a join.

Hashing cuts long texts at words, with an overlap of four words (the least hash of a bin is that of
its parts), so memory beside the text itself does not grow with its length.

Defined results: a null text is an empty one; a text of fewer than five words has its whole sequence
as the one shingle; a text without words has the empty fingerprint, alike (1.0) to another empty one
and to nothing else (0.0); equal texts have equal fingerprints and likeness 1.0; rows that share
an id follow one another by the hash of their text, rows without an id come first; the last row's
next is the first, and a single row is its own next; an empty table gives no rows; columns other
than the named ones are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.llm.scratch import Scratch
from bazaarlens.llm.text import mix, utf8, window_hashes, word_bounds, word_hashes
from bazaarlens.llm.tokens import HASH_BYTES, slices

#: Words of a shingle; bins, a power of two; bits stored of each bin.
WORDS, BINS, BITS = 5, 512, 4
EMPTY = np.uint64(2**64 - 1)
RESULT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def pieces(data: np.ndarray, limit: int = HASH_BYTES) -> Iterator[np.ndarray]:
    """A text's bytes in pieces of about ``limit``, cut between words; a piece starts with the last
    ``WORDS - 1`` words of the one before, so each shingle lies in a piece whole."""
    at, size = 0, limit
    while len(data) - at > size:
        starts, ends, _ = word_bounds(data[at : at + size], np.array([0, size]))
        if len(starts) <= 2 * WORDS:  # few and very long words: a longer piece
            size *= 2
            continue
        yield data[at : at + ends[-2]]  # the last word may go on behind the piece
        at, size = at + int(starts[-WORDS]), limit
    yield data[at:]


def bin_minima(texts: pa.Array, bins: int = BINS) -> np.ndarray:
    """For each text the least hash of each bin, ``EMPTY`` where no shingle falls."""
    data, offsets = utf8(texts)
    out = np.full(len(texts) * bins, EMPTY, dtype=np.uint64)
    shift = np.uint64(64 - bins.bit_length() + 1)
    waiting: list[tuple[int, np.ndarray]] = []

    def settle() -> None:
        own = np.array([k for k, _ in waiting], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(p) for _, p in waiting])))
        words, _, _, first = word_hashes(np.concatenate([p for _, p in waiting]), bounds, lower=True)
        n, windows = np.diff(first), window_hashes(words, WORDS)
        full = np.maximum(n - WORDS + 1, 0)
        at = np.repeat(first[:-1] - np.cumsum(full) + full, full) + np.arange(full.sum())
        owners, hashes = [np.repeat(own, full)], [windows[at]]
        for k in np.flatnonzero((n > 0) & (n < WORDS)).tolist():
            owners.append(own[k : k + 1])
            hashes.append(window_hashes(words[first[k] : first[k + 1]], int(n[k])))
        owner, h = np.concatenate(owners), np.concatenate(hashes)
        np.minimum.at(out, owner * bins + (h >> shift).astype(np.int64), h)
        waiting.clear()

    held = 0
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for piece in pieces(data[a:b]):
            waiting.append((k, piece))
            held += len(piece)
            if held >= HASH_BYTES:
                settle()
                held = 0
    if waiting:
        settle()
    return out.reshape(len(texts), bins)


@functools.cache
def _order(bins: int) -> np.ndarray:
    """For each bin an order of all bins, in which it looks for one that is not empty."""
    rng = np.random.default_rng(20250611)
    return rng.permuted(np.tile(np.arange(bins, dtype=np.int64), (bins, 1)), axis=1)


def densified(minima: np.ndarray) -> np.ndarray:
    """Empty bins filled from the first bin of their order that is not; rows without any stay empty."""
    n, bins = minima.shape
    flat, order = minima.ravel().copy(), _order(bins)
    filled = flat != EMPTY
    missing = np.flatnonzero(~filled & np.repeat(filled.reshape(n, bins).any(axis=1), bins))
    row, own = missing // bins * bins, missing % bins
    for turn in range(bins):
        if not len(missing):
            break
        donor = row + order[own, turn]
        found = filled[donor]
        flat[missing[found]] = flat[donor[found]]
        missing, row, own = missing[~found], row[~found], own[~found]
    return flat.reshape(n, bins)


def packed(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low bits of each bin, hashed with its number, end to end in bytes."""
    n, bins = minima.shape
    low = (mix(minima + np.arange(1, bins + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(2**bits - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low.reshape(n, bins, 1), axis=2)[:, :, 8 - bits :].reshape(n, bins * bits), axis=1)


def fingerprints(texts: pa.Array, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """The fingerprint of each text, empty for one without words."""
    minima = bin_minima(texts, bins)
    some = (minima != EMPTY).any(axis=1).tolist()
    return [p.tobytes() if s else b"" for p, s in zip(packed(densified(minima), bits), some)]


def likeness(a: list[bytes], b: list[bytes], bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity of each pair of fingerprints, chance agreement taken out."""
    out = np.array([float(x == y) for x, y in zip(a, b)])
    both = [k for k, (x, y) in enumerate(zip(a, b)) if x and y and x != y]
    if both:
        x, y = (np.unpackbits(np.frombuffer(b"".join(f[k] for k in both), np.uint8).reshape(len(both), -1), axis=1).reshape(len(both), -1, bits) for f in (a, b))
        chance = 2.0**-bits
        out[both] = np.clip(((x == y).all(axis=2).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)
    return out


def _text(fingerprint: bytes) -> str:
    return base64.b64encode(fingerprint).decode()


def _judged(ids: list, texts: list[str], own: list[bytes], after: list[str], next_own: list[bytes]) -> list[list]:
    """Columns of ``RESULT`` for texts and their next ones."""
    cut = [len(t) // 4 for t in texts]
    edited = [t[: len(t) - c] + n[:c] for t, c, n in zip(texts, cut, after)]
    new = fingerprints(pa.array(edited, pa.large_string()))
    return [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [_text(f) for f in own], [_text(f) for f in new], likeness(own, new).tolist(), likeness(own, next_own).tolist()]


def _batch(columns: list[list], *more: tuple[str, list, pa.DataType]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [f.split()[0] for f in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)] + [pa.array(c, t) for _, c, t in more], names=names + [n for n, _, _ in more])


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``: one row
    per document.  The edited text has its last quarter of code points replaced by as many first
    ones of the next document, or all of them."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        edge = lambda role, row: _batch([[row[0]], *[[None]] * 6], ("part", [part], pa.int32()), ("role", [role], pa.string()), ("text", [row[1]], pa.string()), ("own", [row[2]], pa.binary()))
        for batch in batches:
            for piece in slices(batch, 1):
                ids, texts, own = piece.column(0).to_pylist(), piece.column(1).to_pylist(), fingerprints(piece.column(1))
                if last is None:
                    yield edge("first", (ids[0], texts[0], own[0]))
                else:
                    ids, texts, own = [last[0], *ids], [last[1], *texts], [last[2], *own]
                last = ids[-1], texts[-1], own[-1]
                if n := len(ids) - 1:
                    columns = _judged(ids[:-1], texts[:-1], own[:-1], texts[1:], own[1:])
                    yield _batch(columns, ("part", [part] * n, pa.int32()), ("role", ["row"] * n, pa.string()), ("text", [None] * n, pa.string()), ("own", [None] * n, pa.binary()))
        if last is not None:
            yield edge("last", last)

    found = scratch.table(dealt.mapInArrow(judge, f"{RESULT}, part int, role string, text string, own binary"), "judged")
    # One row a range: each range's last row meets the first of the range after it, the last range's that of the first one.
    firsts = found.filter("role = 'first'")
    parts = firsts.select("part", F.coalesce(F.lead("part").over(W.orderBy("part")), F.min("part").over(W.partitionBy())).alias("next"))
    after = firsts.select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("own").alias("next_own"))
    edges = found.filter("role = 'last'").select("part", "id", "text", "own").join(parts, "part").join(after, "next").select("id", "text", "own", "next_text", "next_own")

    def judge_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _batch(_judged([r["id"]], [r["text"]], [r["own"]], [r["next_text"]], [r["next_own"]]))

    return found.filter("role = 'row'").drop("part", "role", "text", "own").unionByName(edges.mapInArrow(judge_edges, RESULT))


def digest(pairs: DataFrame) -> DataFrame:
    return pairs.withColumnRenamed("id", "doc_id")
