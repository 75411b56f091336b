"""Repeated byte windows by a depth-limited radix sort of suffixes.

A window of 100 bytes is a suffix cut at its depth limit.  Two suffixes are equal to that depth
exactly if they fall into one group in every most-significant-digit pass; what is left in groups
of two or more are the repeated windows, and all but the first of a group are removed.

First digit: the least 16-byte gram of the window by hash (leftmost on ties) with its offset.
The windows that share one gram at one place of a text travel as one *anchor* row, about one
for each 45 bytes, so no window is ever a row by itself.  A shuffle groups anchors by gram and
drops grams that occur once.  The anchors left fetch their bytes, meet again by gram, and the
tasks sort their windows by further digits, each a 64-bit fingerprint of 25 bytes, dropping
windows that stand alone after each pass.  Anchors with equal contexts are settled at once.

A gram of more anchors than a task's share of all, and of more than ``COMMON``, is dealt over
all tasks, in both shuffles.  For the first one a sample of the texts tells these
grams: one that the sample holds twice is shared for certain, so its anchors need not meet to be
kept.  For the second one the first shuffle has counted the others.  The sample changes where
anchors go and nothing else.  Windows of dealt-out grams go on as rows, and Spark groups them with
combining aggregates; so do the windows of any gram with more than ``GROUP`` anchors that is not
among the ``MOST`` largest, which alone are broadcast.

Texts are written once, in buckets of their row numbers, and never move again: the anchors of a
text and the runs to remove are shuffled to them.  Both are gathered by text, as the text itself is.

Order: by id (nulls first), then row, then start.  Results are exact up to the collision of 64-bit
fingerprints.

Defined results: a null text is empty; texts shorter than the window lose nothing; rows that
share an id are ordered by their row numbers, which are written once; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.scratch import Scratch
from bazaarlens.llm.text import mix, prefix_hash, utf8
from bazaarlens.llm.tokens import slices

WINDOW, GRAM, DIGIT = 100, 16, 25
#: Anchors of one gram that a task holds; anchors and windows sorted at once.
GROUP, AT_ONCE, WINDOWS = 100_000, 4096, 400_000
#: Anchors of one gram that go to one task, and the grams of more that are dealt out, the largest first.
COMMON, MOST = 1 << 14, 100_000
#: One text in so many is read before to find common grams; the mark of their anchors.
SAMPLE, HOT = 64, 1 << 62
_NONE = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hash, place, and first and last window start of each anchor of a batch of texts."""
    w = window - GRAM + 1
    m = len(data) - GRAM + 1
    n = m - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    sums, inverse = prefix_hash(data)
    h = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:m])
    # Sliding leftmost minimum: the least of a block's suffix and of the next block's prefix.
    x = np.concatenate([h, np.full(-m % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    place = np.arange(x.size).reshape(-1, w)
    prefix, suffix = np.minimum.accumulate(x, axis=1), np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1]
    fresh = np.ones_like(x, dtype=bool)
    fresh[:, 1:] = x[:, 1:] < prefix[:, :-1]
    prefix_at = np.maximum.accumulate(np.where(fresh, place, -1), axis=1).ravel()
    suffix_at = np.minimum.accumulate(np.where(x == suffix, place, _NONE)[:, ::-1], axis=1)[:, ::-1].ravel()
    left, right = suffix.ravel()[:n], prefix.ravel()[w - 1 : w - 1 + n]
    at = np.where(left <= right, suffix_at[:n], prefix_at[w - 1 : w - 1 + n])
    # Windows within one text; a run of them with the same least gram is an anchor.
    inside = np.zeros(n + 1, dtype=np.int64)
    sizes = np.diff(offsets)
    long_ = sizes >= window
    np.add.at(inside, offsets[:-1][long_], 1)
    np.add.at(inside, offsets[1:][long_] - window + 1, -1)
    start = np.flatnonzero(np.cumsum(inside)[:n])
    at = at[start]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(at))[: len(new)] - 1
    return h[at[new]], at[new], start[new], start[last]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, row, at) of each text's anchors; ``at`` packs place, reach back and forward."""
    for batch in batches:
        for part in slices(batch, 1):
            data, offsets = utf8(part.column(1))
            gram, place, first, last = anchors(data, offsets)
            doc = np.searchsorted(offsets, place, side="right") - 1
            row = part.column(0).to_numpy()[doc]
            at = (place - offsets[doc]) << 16 | (place - first) << 8 | (place - last)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(row), pa.array(at)], names=["gram", "row", "at"])


def _shared(common: int):
    """Of rows sorted by gram, those whose gram the row before or after has, too, and all that
    are marked by ``HOT`` in their place.  Another gram of more than ``common`` rows is counted: a row with the count for its row
    number and no place follows it."""
    names = ["gram", "row", "at"]

    def counted(grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        many = counts > common
        return pa.RecordBatch.from_arrays([pa.array(grams[many]), pa.array(counts[many], pa.int64()), pa.nulls(int(many.sum()), pa.int64())], names=names)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        n = 0  # rows so far of the gram of the row that waits, itself included
        for batch in batches:
            hot = batch.column(2).to_numpy() >= HOT
            if hot.any():
                known = batch.filter(pa.array(hot))
                yield pa.RecordBatch.from_arrays([known.column(0), known.column(1), pa.array(known.column(2).to_numpy() - HOT)], names=names)
                batch = batch.filter(pa.array(~hot))
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            gram = table.column(0).to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            sizes = np.diff(np.append(heads, len(gram)))
            counts = sizes.copy()
            counts[0] += max(0, n - 1)  # rows of the first gram that have gone on before
            # The last gram's rows may go on: one of them waits.
            keep = np.repeat(counts > 1, sizes)
            yield table.slice(0, len(gram) - 1).filter(pa.array(keep[:-1]))
            yield counted(gram[heads[:-1]], counts[:-1])
            held, n = table.slice(len(gram) - 1), int(counts[-1])
        if held is not None and n > 1:
            yield held
            yield counted(held.column(0).to_numpy(), np.array([n]))

    return shared


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (row, id, text, anchors): the bytes around each anchor, and their fingerprint."""
    for batch in batches:
        for part in slices(batch, 2):
            data, offsets = utf8(part.column(2))
            lists = part.column(3).combine_chunks() if isinstance(part.column(3), pa.ChunkedArray) else part.column(3)
            flat = lists.flatten()
            at, gram = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            doc = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
            place = offsets[doc] + (at >> 16)
            start, end = place - (at >> 8 & 255), place - (at & 255) + WINDOW
            sums, inverse = prefix_hash(data)
            full = mix((sums[end] - sums[start]) * inverse[start] + (at & 0xFFFF).astype(np.uint64))
            raw = data.tobytes()
            bytes_ = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
            # A context that its own text holds earlier is settled here; it travels without bytes, to any task.
            order = np.lexsort((at >> 16, full, doc))
            again = order[1:][(full[order][1:] == full[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
            gram = gram.copy()
            gram[again] = mix(full[again] + at[again].astype(np.uint64)).view(np.int64)
            for k in again.tolist():
                bytes_[k] = None
            index = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(gram), part.column(1).take(index), part.column(0).take(index), pa.array(at), pa.array(full.view(np.int64)), pa.array(bytes_, pa.binary())],
                                             names=["gram", "id", "row", "at", "full", "bytes"])


FOUND = "row long, start long, stop long, print1 long, print2 long"


def _found(row: np.ndarray, start: np.ndarray, stop: np.ndarray, prints: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(row), pa.int64())
    one, two = (none, none) if prints is None else (pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(start), pa.array(stop), one, two], names=["row", "start", "stop", "print1", "print2"])


class _Block:
    """Anchors of some grams, in order, with what their windows need."""

    def __init__(self, rows: pa.Table) -> None:
        self.gram, self.row, self.at, full = (rows[c].to_numpy() for c in ("gram", "row", "at", "full"))
        self.back, self.fore, self.place = self.at >> 8 & 255, self.at & 255, self.at >> 16
        _, group = np.unique(self.gram, return_inverse=True)
        key = np.stack([group, full], axis=1)
        _, head = np.unique(key, axis=0, return_index=True) if len(key) else (None, np.zeros(0, np.int64))
        self.head = np.zeros(len(group), dtype=bool)
        self.head[head] = True  # return_index gives the first, which is the earliest
        self.group = group
        self.data = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8)
        size = self.back - self.fore + WINDOW
        self.begin = np.cumsum(size) - size

    def settled(self) -> pa.RecordBatch:
        """Anchors that an earlier equal context covers: all their windows are repeats."""
        k = np.flatnonzero(~self.head)
        return _found(self.row[k], self.place[k] - self.back[k], self.place[k] - self.fore[k] + WINDOW)

    def windows(self, chosen: np.ndarray, low: int = 0, high: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, place of the gram in the window (low <= place < high), and first byte of each
        window of the chosen."""
        back = np.minimum(self.back[chosen], high - 1)
        n = np.maximum(back - np.maximum(self.fore[chosen], low) + 1, 0)
        owner, back = np.repeat(chosen, n), np.repeat(back, n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        return owner, back - step, self.begin[owner] + self.back[owner] - back + step

    def repeats(self) -> Iterator[pa.RecordBatch]:
        """Most-significant-digit passes over the windows of the heads.  Windows that hold the
        gram at different places never meet, so many windows are taken a few places at a time."""
        counts = np.bincount(self.group[self.head], minlength=int(self.group.max()) + 1 if len(self.group) else 0)
        chosen = np.flatnonzero(self.head & (counts[self.group] > 1))
        hashes = prefix_hash(self.data)
        places = max(1, WINDOWS // max(1, len(chosen)))
        for low in range(0, WINDOW, places):
            yield self._equal(*self.windows(chosen, low, low + places), *hashes)

    def _equal(self, owner: np.ndarray, offset: np.ndarray, first: np.ndarray, sums: np.ndarray, inverse: np.ndarray) -> pa.RecordBatch:
        bucket = self.group[owner] * (WINDOW + 1) + offset
        alive = np.arange(len(owner))
        for depth in range(-1, WINDOW // DIGIT):
            if depth >= 0:
                a = first[alive] + depth * DIGIT
                digit = mix((sums[a + DIGIT] - sums[a]) * inverse[a])
                key = mix(digit + bucket[alive].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            else:
                key = bucket[alive].astype(np.uint64)
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            label = np.cumsum(np.concatenate(([0], ~same)))
            many = np.bincount(label)[label] > 1 if len(label) and len(order) else np.zeros(0, bool)
            order, label = order[many], label[many]
            bucket[alive[order]] = label
            alive = np.sort(alive[order])
            if not len(alive):
                break
        # Of each group, the first in order stays.
        _, head = np.unique(bucket[alive], return_index=True)
        again = np.delete(alive, head)
        start = self.place[owner[again]] - offset[again]
        new = np.flatnonzero(np.concatenate(([True], (owner[again][1:] != owner[again][:-1]) | (start[1:] != start[:-1] + 1)))) if len(again) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(again))[: len(new)] - 1
        return _found(self.row[owner[again[new]]], start[new], start[last] + WINDOW)

    def rows(self) -> pa.RecordBatch:
        """The heads' windows as rows with two fingerprints, for groups too large to hold."""
        owner, offset, first = self.windows(np.flatnonzero(self.head))
        sums, inverse = prefix_hash(self.data)
        whole = (sums[first + WINDOW] - sums[first]) * inverse[first]
        half = mix((sums[first + WINDOW // 2] - sums[first]) * inverse[first])
        start = self.place[owner] - offset
        return _found(self.row[owner], start, start + WINDOW, np.stack([mix(whole), half], axis=1))


def _sort(group_limit: int):
    at_once = min(AT_ONCE, group_limit)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # whole grams, and the last one as far as it came
        size, large = 0, None  # large: the gram whose windows go on as rows

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows:
                block = _Block(rows.combine_chunks())
                yield block.settled()
                yield from block.repeats()

        def as_rows(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            block = _Block(rows)
            yield block.settled()
            yield block.rows()

        for batch in batches:
            bare = batch.filter(pa.compute.is_null(batch.column("bytes")))
            if bare.num_rows:
                at = bare.column("at").to_numpy()
                yield _found(bare.column("row").to_numpy(), (at >> 16) - (at >> 8 & 255), (at >> 16) - (at & 255) + WINDOW)
                batch = batch.filter(pa.compute.is_valid(batch.column("bytes")))
            dealt = batch.filter(batch.column("common"))  # grams of which other tasks hold more
            for k in range(0, dealt.num_rows, at_once):
                yield from as_rows(pa.Table.from_batches([dealt.slice(k, at_once)]))
            batch = batch.filter(pa.compute.invert(batch.column("common")))
            for k in range(0, batch.num_rows, at_once):
                piece = batch.slice(k, at_once)
                gram = piece.column(0).to_numpy()
                if large is not None:
                    own = int(np.searchsorted(gram != large, True))
                    if own:
                        yield from as_rows(pa.Table.from_batches([piece.slice(0, own)]))
                        piece, gram = piece.slice(own), gram[own:]
                    if len(gram):
                        large = None
                if not len(gram):
                    continue
                waiting.append(piece)
                size += piece.num_rows
                if size < at_once:
                    continue
                rows = pa.Table.from_batches(waiting)
                gram = rows["gram"].to_numpy()
                cut = int(np.searchsorted(gram == gram[-1], True))  # the last gram may go on
                yield from flush(rows.slice(0, cut))
                rows = rows.slice(cut)
                if rows.num_rows > group_limit:
                    large = int(gram[-1])
                    yield from as_rows(rows.combine_chunks())
                    rows = rows.slice(rows.num_rows)
                waiting, size = rows.to_batches(), rows.num_rows if rows.num_rows < at_once else 0
        yield from flush(pa.Table.from_batches(waiting) if waiting else pa.table({"gram": []}))

    return sort


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP, common: int = COMMON, sample: int = SAMPLE) -> DataFrame:
    """``row, spans``: for each text with repeats the maximal runs of bytes to remove, as
    structs of start and stop."""
    return _spans(*_texts(docs, id_col, text_col), group_limit, common, sample)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(docs.sparkSession, "suffixes")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = scratch.bucketed(rows, "row", "texts")
    scratch.release()
    return texts, scratch


def _spans(texts: DataFrame, scratch: Scratch, group_limit: int, common: int, sample: int) -> DataFrame:
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    find = lambda df: df.select("row", "text").mapInArrow(_find, "gram long, row long, at long")
    seen = find(texts.filter(F.pmod(F.xxhash64("row"), F.lit(sample)) == 0)).groupBy("gram").agg(F.count("*").alias("n"))
    seen = scratch.table(seen, "seen")
    most = max(common, (seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * sample) // tasks)
    largest = lambda df: df.filter(F.col("n") > most).orderBy(F.desc("n"), "gram").limit(MOST)
    hot = scratch.table(largest(seen.filter("n > 1").select("gram", (F.col("n") * sample).alias("n"))), "hot")
    # A common gram's anchors are dealt by row over all tasks; no column is shuffled for that.
    deal = lambda known: F.when(known, F.xxhash64("gram", F.pmod(F.xxhash64("row"), F.lit(tasks)))).otherwise(F.col("gram"))
    found = find(texts).join(F.broadcast(hot), "gram", "left").select("gram", "row", F.when(F.col("n").isNotNull(), F.col("at") + HOT).otherwise(F.col("at")).alias("at"))
    shared = found.repartition(deal(F.col("at") >= HOT)).sortWithinPartitions("gram").mapInArrow(_shared(common), "gram long, row long, at long")
    shared = scratch.table(shared, "shared")
    scratch.release()
    counted, placed = largest(shared.filter("at is null").select("gram", F.col("row").alias("n"))), shared.filter("at is not null")
    lists = placed.groupBy("row").agg(F.collect_list(F.struct("at", "gram")).alias("anchors"))
    kind = texts.schema["id"].dataType.simpleString()
    around = texts.join(lists.hint("shuffle_hash"), "row").select("row", "id", "text", "anchors")
    around = around.mapInArrow(_contexts, f"gram long, id {kind}, row long, at long, full long, bytes binary")
    around = around.join(F.broadcast(counted.unionByName(hot)), "gram", "left").withColumn("common", F.col("n").isNotNull()).drop("n")
    dealt = around.repartition(deal(F.col("common")))
    ordered = dealt.sortWithinPartitions("gram", F.when(F.col("common"), F.col("full")), F.asc_nulls_first("id"), "row", "at")
    out = scratch.table(ordered.mapInArrow(_sort(group_limit), FOUND), "repeats")
    scratch.drop("shared")
    scratch.release()
    # Windows of large groups: all but the earliest of equal ones.
    rows = texts.select("row", "id").join(out.filter("print1 is not null").hint("shuffle_hash"), "row")
    order = F.struct(F.col("id").isNotNull(), "id", "row", "start")
    first = rows.groupBy("print1", "print2").agg(F.min(order).alias("least"), F.count("*").alias("n")).filter("n > 1")
    more = rows.join(first, ["print1", "print2"]).filter(order != F.col("least")).select("row", "start", "stop")
    spans = out.filter("print1 is null").select("row", "start", "stop").unionByName(more)
    spans = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    # Runs that touch or overlap are one.
    joined = F.aggregate("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>"), lambda done, s: F.when(
        (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["stop"]),
        F.array_append(F.slice(done, F.lit(1), F.size(done) - 1), F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["stop"], s["stop"]).alias("stop"))),
    ).otherwise(F.array_append(done, s)))
    return scratch.table(spans.select("row", joined.alias("spans")), "spans")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            n_bytes, removed, kept = [], [], []
            for text, spans in zip(part.column(1), part.column(2)):
                raw, at, pieces = text.as_buffer().to_pybytes() if text.is_valid else b"", 0, []
                for s in spans.as_py() or []:
                    pieces.append(raw[at : s["start"]])
                    at = s["stop"]
                pieces.append(raw[at:])
                kept.append(b"".join(pieces))
                n_bytes.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), part.column(2), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "spans", "kept"])


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_limit: int = GROUP, common: int = COMMON, sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, spans, and the bytes that are left."""
    texts, scratch = _texts(docs, id_col, text_col)
    joined = texts.join(_spans(texts, scratch, group_limit, common, sample).hint("shuffle_hash"), "row", "left").select("id", "text", "spans")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(_remove, f"id {kind}, n_bytes long, n_removed long, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def digest(out: DataFrame) -> DataFrame:
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
