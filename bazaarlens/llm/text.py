"""Vectorised text helpers that run inside Arrow batches.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  All those separators are
ASCII, so words of UTF-8 text can be found on bytes.  Hashes are 64-bit: a random value per
byte, weighted by powers of an odd base, summed over the word; prefix sums give the hash of
every word of a batch without a Python loop.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240131)
#: A random 64-bit value for each byte; with A-Z lowered; and which bytes separate words.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = int(_RNG.integers(2**40, 2**62)) * 8 + 5
_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (xor-shift and multiply, twice)."""
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, nulls as empty, and the n + 1 offsets of its rows."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_VALUE) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums H (n + 1 values) of weighted bytes, and the inverse weights: the hash of
    ``data[s:e]`` is ``(H[e] - H[s]) * inverse[s]``, modulo 2**64."""
    n = len(data)
    weights, inverse = powers(BASE, n + 1), powers(pow(BASE, -1, 2**64), n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(table[data] * weights[:n], out=sums[1:])
    return sums, inverse


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next batch of this Python worker."""
    if len(have := _POWERS.get(base, np.zeros(0, np.uint64))) < n:
        have = np.full(max(n, 1 << 16), base % 2**64, dtype=np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each row the index of its first word (n + 1 values)."""
    ink = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | first[:-1]))
    after = np.empty(len(data), dtype=bool)
    if len(data):
        after[-1] = False
        after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and each row's first word (n + 1 values)."""
    starts, ends, rows = word_bounds(data, offsets)
    sums, inverse = prefix_hash(data, LOWER_VALUE if lower else BYTE_VALUE)
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts, ends, rows


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; windows over row ends are for callers to drop."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = words[:m] * _MULT[0]
    for j in range(1, n):
        total = total + words[j : j + m] * _MULT[j]
    return mix(total ^ np.uint64(n))


def shingle_sets(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its n-word shingles, A-Z lowered; a row of
    fewer words has its whole sequence as the one shingle, a row without words none."""
    data, offsets = utf8(texts)
    words, _, _, rows = word_hashes(data, offsets, lower=True)
    windows = window_hashes(words, n)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= n:
            own = np.sort(windows[a : b - n + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(window_hashes(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
