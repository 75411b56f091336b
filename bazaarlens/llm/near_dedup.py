"""Near-duplicate documents by MinHash.

Signatures: the minima of many universal hashes over a text's distinct five-word shingles,
A-Z lowered.  Texts of the same set are one class from the start.  Classes that agree in all
minima of a band meet in that band's bucket.

Links are confirmed on full shingle sets, in two rounds, so that no bucket's pairs are written
out.  The first pairs each class with a few of the smallest classes of its buckets, those whose
signatures agree most; the components of the confirmed links label all buckets.  Only buckets
that still hold several components go on: there all pairs across components are compared by
signature, inside the tasks, in blocks of bounded size (a bucket of any size is cut into blocks,
and every two blocks meet).  Each pair is taken in the first band that both share, told by 32
bits of each band's hash, as the signatures' bytes may agree where the minima do not.  What the
signatures leave possible is confirmed on full sets: in large buckets on the spot, in small
ones, whose pairs are few, after a join.  Components of all confirmed links, by alternating
large-star and small-star, are the groups.

A pair of similarity 0.75 shares no bucket with probability (1 - 0.75**6)**64 = 3.6e-6; a
confirmed link is exact up to the collision of 64-bit shingle hashes.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; one of
fewer than five words has its whole sequence as the one shingle; repeated rows get one row each;
rows of a null id are classes like others but bring no id, and a group of only such rows has a
null component; an empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.llm.components import connected_components
from bazaarlens.llm.scratch import Scratch, fresh
from bazaarlens.llm.text import mix, shingle_sets
from bazaarlens.llm.tokens import slices

BANDS, ROWS, WORDS = 64, 6, 5
#: Bucket members of a block; members from which a bucket's pairs are confirmed where they meet;
#: signature agreement from which a pair is confirmed on full sets (0.75 less five standard
#: deviations of 384 minima); ids that may be broadcast (bytes).
BLOCK, LARGE, POSSIBLE, BROADCAST = 512, 48, 0.64, 32 << 20
#: Smallest classes of its buckets that a class is held against in the first round.
CENTRES = 4
_RNG = np.random.default_rng(977)
_A = (_RNG.integers(0, 2**31, BANDS * ROWS, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_B = _RNG.integers(0, 2**32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_C = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash a * x + b, modulo 2**32, over a text's shingles."""
    x, low = (shingles >> np.uint64(32)).astype(np.uint32), np.full(len(_A), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(low, (x[at : at + 1024][None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return low


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (row, text, ...), columns beyond the text included: row, n_shingles, two hashes of the
    whole set, band hashes, 32 bits of each of them, one byte of each minimum, and what came along."""
    band = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        for part in slices(batch, 1):
            sizes, keys, again, bands, meets, bytes_ = [], [], [], [], [], []
            for own in shingle_sets(part.column(1), WORDS):
                sizes.append(len(own))
                keys.append(int(mix(own.sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own))).view(np.int64)[0]) if len(own) else 0)
                again.append(int(np.bitwise_xor.reduce(mix(own)).view(np.int64)) if len(own) else 0)
                low = minima(own)
                meet = mix((low.reshape(BANDS, ROWS).astype(np.uint64) * _C).sum(axis=1, dtype=np.uint64))
                meet = ((meet & ~np.uint64(BANDS - 1)) | band).view(np.int64)  # a bucket's name ends in its band
                bands.append(meet.tolist() if len(own) else [])
                meets.append((meet >> np.int64(32)).astype(np.uint32).tobytes() if len(own) else b"")
                bytes_.append((low >> np.uint32(7)).astype(np.uint8).tobytes() if len(own) else b"")
            made = [pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(again, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(meets, pa.binary()), pa.array(bytes_, pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[2:]], names=["row", "n_shingles", "key1", "key2", "bands", "meets", "signature", *part.schema.names[2:]])


SIGNED = "row long, n_shingles long, key1 long, key2 long, bands array<long>, meets binary, signature binary"


def _linked(one: np.ndarray, two: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of sorted distinct hashes."""
    both = np.sort(np.concatenate([one, two]))
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(both) - common)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, i, j): pairs of different components that may be links, each in
    the first band that both share.  In a block pair i < j the members of block i meet those of
    block j; for i = j, one another.  Where the rows bring full sets, the pairs are confirmed
    here (``sure``), and those that a link found here has connected are left out."""
    def pairs(rows: pa.Table) -> tuple[list, list, bool]:
        sign = np.frombuffer(b"".join(rows["signature"].to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        meets = np.frombuffer(b"".join(rows["meets"].to_pylist()), np.uint32).reshape(rows.num_rows, BANDS)
        node, comp, size, block = (rows[c].to_numpy().copy() for c in ("node", "component", "n_shingles", "block"))
        band, same = rows["band"][0].as_py(), rows["i"][0].as_py() == rows["j"][0].as_py()
        sets = [np.frombuffer(x, np.int64) for x in rows["set"].to_pylist()] if rows["set"].null_count == 0 else None
        one, two = [], []
        for k in range(len(node) - 1):
            rest = slice(k + 1, None)
            ok = (comp[rest] != comp[k]) & (4 * np.minimum(size[rest], size[k]) >= 3 * np.maximum(size[rest], size[k]))
            if not same:
                ok &= block[rest] != block[k]
            at = np.flatnonzero(ok) + k + 1
            if not len(at):
                continue
            at = at[((sign[at] == sign[k]).mean(axis=1) >= POSSIBLE) & ((meets[at] == meets[k]).argmax(axis=1) == band)]
            for j in at.tolist():
                if sets is not None:
                    if comp[j] == comp[k] or not _linked(sets[k], sets[j]):
                        continue
                    comp[comp == comp[j]] = comp[k]
                one.append(min(node[k], node[j]))
                two.append(max(node[k], node[j]))
        return one, two, sets is not None

    def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        one, two, sure = pairs(rows.combine_chunks())
        if one:
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([sure] * len(one))], names=["a", "b", "sure"])

    waiting: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j"))))
        start = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[start]:
                if waiting and key != keys[start]:
                    yield from out(pa.Table.from_batches(waiting))
                    waiting = []
                key = keys[start]
                waiting.append(batch.slice(start, k - start))
                start = k
    if waiting:
        yield from out(pa.Table.from_batches(waiting))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node) sorted so: those of buckets with several nodes, and the bucket's
    first node.  A bucket may go on over batches; only its first row is kept in mind."""
    bucket = least = None
    told = True  # the bucket's first row has been given out
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        heads = np.flatnonzero(np.concatenate(([keys[0] != bucket], keys[1:] != keys[:-1])))
        if len(heads) == 0 or heads[0] != 0:  # the first rows belong to the bucket before
            first, start = np.concatenate(([least], nodes[heads])), np.concatenate(([0], heads))
            goes_on = True
        else:
            first, start = nodes[heads], heads
            goes_on = False
        size = np.diff(np.append(start, len(keys)))
        own = np.repeat(first, size)
        several = np.repeat(size > 1, size)
        if goes_on:
            several[: size[0]] = True
            if not told:
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([least]), pa.array([least])], names=["bucket", "node", "least"])
        yield pa.RecordBatch.from_arrays([pa.array(keys[several]), pa.array(nodes[several]), pa.array(own[several])], names=["bucket", "node", "least"])
        told = bool(several[-1])
        bucket, least = int(keys[-1]), int(own[-1])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, sign_a, sign_b): how far the signatures agree."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sign_a", "sign_b"))
        agree = (one == two).mean(axis=1) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(agree)], names=["a", "b", "agree"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, set_a, set_b), the pairs with 100 * intersection >= 75 * union."""
    for batch in batches:
        keep = [_linked(np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)) for x, y in zip(batch.column("set_a"), batch.column("set_b"))]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), WORDS)], pa.binary())], names=["node", "set"])


class _Texts:
    """Texts of the input by the rows of this run, and the full sets of some of them."""

    def __init__(self, texts: DataFrame, scratch: Scratch) -> None:
        self.texts, self.scratch = texts, scratch

    def sets(self, nodes: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """node, set of the given nodes (column node; ``most`` at most), each made once, from its text."""
        nodes = self.scratch.table(nodes.distinct(), f"{name}-nodes", most)
        few = nodes.count() * 16 <= BROADCAST
        chosen = self.texts.join(F.broadcast(nodes) if few else nodes, self.texts["row"] == nodes["node"]).select("node", "text")
        sets = self.scratch.table(chosen.mapInArrow(_sets, "node long, set binary"), f"{name}-sets")
        self.scratch.drop(f"{name}-nodes")
        return sets

    def confirmed(self, pairs: DataFrame, name: str, n: int) -> DataFrame:
        """Those of n pairs (a, b) that are links."""
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), name, 2 * n)
        one = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        two = one.join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        links = self.scratch.table(two.select("a", "b", "set_a", "set_b").mapInArrow(_similar, "a long, b long"), f"{name}-links", 4 * n)
        self.scratch.drop(f"{name}-sets")
        return links


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row, id, n_shingles, component (the smallest id reachable, itself
    included), first (this row stands for its group)."""
    scratch = Scratch(docs.sparkSession, "near")
    # Each row gets its number, its signature and its text in one table, so the number stays with the text.
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = scratch.table(own.withColumn("whole", F.col("text")).select("row", "text", "id", "whole").mapInArrow(_sign, f"{SIGNED}, id {kind}, whole string"), "signed")
    return _grouped(signed, signed.select("row", F.col("whole").alias("text")), signed.select("row", "id"), scratch)


def _grouped(signed: DataFrame, texts: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``groups`` of signed rows, all of written tables."""
    # One class per distinct set, named by its smallest row; a set is told by two 64-bit hashes and its size.
    key = ["key1", "key2", "n_shingles"]
    keys = signed.select("row", *key)
    rows = signed.count()
    classes = scratch.table(keys.filter("n_shingles > 0").groupBy(*key).agg(F.min("row").alias("node")), "classes", rows)
    n = classes.count()
    heads = signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    entries = heads.select(F.explode("bands").alias("bucket"), F.col("row").alias("node")).repartition("bucket").sortWithinPartitions("bucket", "node")
    members = scratch.table(entries.mapInArrow(_met, "bucket long, node long, least long"), "members", n * BANDS)
    signs = signed.join(members.select(F.col("node").alias("row")).distinct(), "row", "left_semi").select(F.col("row").alias("node"), "n_shingles", "meets", "signature")
    signs = scratch.table(signs, "signs", 4 * n)  # wide rows
    scratch.release()

    named = lambda c: signs.select(F.col("node").alias(c), F.col("signature").alias(f"sign_{c}"))
    centred = members.filter("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    agreeing = centred.join(named("a"), "a").join(named("b"), "b").mapInArrow(_agreeing, "a long, b long, agree double").filter(F.col("agree") >= POSSIBLE)
    best = F.row_number().over(W.partitionBy("b").orderBy(F.desc("agree"), "a"))
    chosen = scratch.table(agreeing.withColumn("n", best).filter(F.col("n") <= CENTRES).select("a", "b"), "chosen", CENTRES * n)
    source = _Texts(texts, scratch)
    pairs = chosen.count()
    first = source.confirmed(chosen, "first", pairs)
    found = connected_components(first, scratch, "first-groups", pairs)
    scratch.release()

    labelled = members.join(found, "node", "left").select("bucket", F.col("bucket").bitwiseAND(F.lit(BANDS - 1)).cast("int").alias("band"), "node", F.coalesce("component", "node").alias("component"))
    labelled = scratch.table(labelled, "labelled", n * BANDS)
    open_ = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members")).filter("low < high").select("bucket", "members")
    open_ = labelled.join(open_, "bucket")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    open_ = open_.withColumn("block", F.when(blocks > 1, F.pmod(F.xxhash64("node"), blocks)).otherwise(0).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    # Members of large buckets bring their sets along; pairs of the others go on as rows.
    large = source.sets(open_.filter(F.col("members") > LARGE).select("node"), "large", n)
    brought = F.when(F.col("members") > LARGE, F.col("set")).alias("set")
    meeting = open_.join(signs.join(large, "node", "left"), "node").select("bucket", "band", "i", "j", "block", "node", "component", "n_shingles", "meets", "signature", brought)
    meeting = meeting.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    rest = meeting.mapInArrow(_across, "a long, b long, sure boolean").distinct().join(chosen, ["a", "b"], "left_anti")
    rest = scratch.table(rest, "rest")
    scratch.drop("large-sets")
    scratch.release()
    more = rest.count()
    second = source.confirmed(rest.filter("not sure").select("a", "b"), "second", more).unionByName(rest.filter("sure").select("a", "b"))
    found = connected_components(first.unionByName(second), scratch, "groups", pairs + more)
    for name in ("members", "signs", "labelled", "chosen", "rest"):
        scratch.drop(name)
    scratch.release()

    # Back to rows: class of the set, component of the class, smallest id of the component.
    by_class = classes.join(found, "node", "left").select(*key, F.coalesce("component", "node").alias("component"))
    placed = keys.join(by_class, key, "left").join(ids, "row")
    alone = F.col("component").isNull()
    placed = scratch.table(placed.select("row", "id", "n_shingles", F.when(alone, -1 - F.col("row")).otherwise(F.col("component")).alias("group")), "placed", rows)
    least = placed.groupBy("group").agg(F.min_by("id", F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("component"), F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("head"))
    return placed.join(least, "group").select("row", "id", "n_shingles", "component", (F.col("row") == F.col("head")).alias("first"))


def digest(grouped: DataFrame) -> DataFrame:
    return grouped.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, one of each group; those without words all stay."""
    scratch, row = Scratch(docs.sparkSession, "deduplicated"), fresh(docs, "__row")
    numbered = scratch.numbered(docs, row)
    texts = numbered.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.table(texts.mapInArrow(_sign, SIGNED), "signed")
    grouped = _grouped(signed, texts, numbered.select(F.col(row).alias("row"), F.col(id_col).alias("id")), scratch)
    gone = scratch.table(grouped.filter("not first").select(F.col("row").alias(row)), "gone")
    small = gone.count() * 16 <= BROADCAST
    return numbered.join(F.broadcast(gone) if small else gone, row, "left_anti").select(*docs.columns)
