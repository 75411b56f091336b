"""Packing by minimum bin slack.

Documents' ids are cut at the window size; whole windows stand alone, the remainders wait in a
pool.  For each window the longest remainder is set, and bitset subset-sum dynamic programming
over the pool's lengths (with their counts) finds the sum closest to what is left; walking the
bitsets back gives how many remainders of each length go in.  The search ends as soon as the
window can be filled to the last token, so a full pool costs a few shifts a window.

Each input partition packs its own documents, in one pass and without a shuffle; the pool is
bounded.  A window that the pool fills badly takes a part of a waiting remainder, whose rest goes
on waiting.  At a partition's end the last windows may be short: one with little slack is padded,
another is cut into sequences of power-of-two lengths, which need no padding.

Defined results: a null or empty text has the end id only; repeated rows are packed each;
an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.tokens import gathered, tokenizer

#: Remainders that wait at most, those left after packing, and the slack that is padded.
POOL, LEFT, SLACK = 4096, 1024, 32
PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length, within ``counts``, sum closest to ``room`` from below."""
    reach, levels = 1, []
    mask, full = (1 << (room + 1)) - 1, 1 << room
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        levels.append((length, reach))
        for _ in range(min(counts[length], room // length)):
            reach |= (reach << length) & mask
        if reach & full:
            break
    left, picked = reach.bit_length() - 1, {}
    for length, before in reversed(levels):
        n = 0
        while not before >> left & 1:
            left -= length
            n += 1
        if n:
            picked[length] = n
    return picked


class Packer:
    """Windows of one partition; a piece is (doc, start, ids, tokens of its document)."""

    def __init__(self, window: int, first_id: int) -> None:
        self.window, self.next_id = window, first_id
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc: object, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for a in range(0, n - n % w, w):
            self._emit([(doc, a, ids[a : a + w], n)])
        if n % w:
            self._put((doc, n - n % w, ids[n - n % w :].copy(), n))
            if self.waiting > POOL:
                self.pack(LEFT)

    def pack(self, left: int) -> None:
        while self.waiting > left:
            longest = max(self.pool)
            pieces = [self._take(longest)]
            for length, n in fill({k: len(v) for k, v in self.pool.items()}, self.window - longest).items():
                pieces += [self._take(length) for _ in range(n)]
            total = sum(len(p[2]) for p in pieces)
            if left and self.window - total > SLACK:
                if not self.pool:  # all that waits does not fill a window: it waits for more
                    for piece in pieces:
                        self._put(piece)
                    return
                # Any remainder that still waits is longer than the slack: the longest is cut to fill it.
                doc, start, ids, n = self._take(max(self.pool))
                room = self.window - total
                pieces.append((doc, start, ids[:room], n))
                self._put((doc, start + room, ids[room:], n))
                total = self.window
            if left or self.window - total <= SLACK:
                self._emit(pieces)
            else:
                self._cut(pieces, total)

    def _put(self, piece: tuple) -> None:
        self.pool[len(piece[2])].append(piece)
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        piece = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.waiting -= 1
        return piece

    def _cut(self, pieces: list[tuple], total: int) -> None:
        """Sequences of power-of-two lengths, longest first, that hold ``pieces`` in order."""
        while total:
            room, own = 1 << (total.bit_length() - 1), []
            total -= room
            while room:
                doc, start, ids, n = pieces.pop(0)
                own.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], n))
                room -= len(own[-1][2])
            self._emit(own)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, len(ids), n, self.next_id, offset, ids.tobytes()))
            offset += len(ids)
        self.next_id += 1

    def take_rows(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (binary:
    little-endian unsigned 32-bit)."""
    field = docs.schema[id_col]
    names = ["id", *[x.split()[0] for x in PIECE.split(", ")]]

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        kinds = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.take_rows()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for part in gathered(batches, 1):
            kinds = [part.schema.field(0).type, *[pa.int64()] * 5, pa.binary()]
            ids, offsets = tokenizer(tokenizer_path, end_id).encode(part.column(1))
            for doc, a, b in zip(part.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                packer.add(doc, ids[a:b])
            if packer.rows:
                yield out()
        packer.pack(0)
        if packer.rows:
            yield out()

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(batches, f"id {field.dataType.simpleString()}, {PIECE}")


def digest(packed: DataFrame) -> DataFrame:
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
