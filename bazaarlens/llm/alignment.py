"""Cross-tokenizer alignment, relational on Spark.

Two tokenizers cut the same bytes into tokens.  Where tokens of both end at one byte is a cut; the
tokens between two cuts are a group, and the two tokens that end at a cut are linked.  Token rows
come from ``posexplode``, their ends from windowed sums of byte lengths, links from an equi-join on
text and end, and a token's group from the running count of cuts before it.

Neither tokenizer has a token that goes on from a visible character into white space (their
vocabularies are checked for that), so a space or line feed after a visible character is always a
cut, and what stands between two such places, a chunk, is cut alike wherever it stands.  So distinct
chunks, not documents, are what is tokenized and joined; a chunk's links count as often as it occurs.

1. Texts are written in blocks of about ``BLOCK`` bytes: a row holds the block's distinct chunks, and
   for each document the places of its chunks among them.
2. Distinct chunks of all blocks are counted, tokenized (Arrow batches) and aligned (joins, windows).
3. Links are counted corpus-wide.  The two tokens of a link end in the same bytes, so one is the end
   of the other and there are at most as many pairs as bytes in both vocabularies: these counts are
   broadcast.
4. The results of chunks go back to the blocks that hold them, and a task puts a block's documents
   together.

No key is hot: however common a chunk is, a block has it once, and about ``HOMES`` blocks make a row
of their own of it.

Defined results: texts that are null or empty, or whose tokens' bytes do not give space and text
again, have no tokens and count nowhere; equal rows give equal rows; a row without an id gives a row
without one; an empty table gives no rows; columns other than the named ones are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.llm.scratch import Scratch
from bazaarlens.llm.text import utf8
from bazaarlens.llm.tokens import gathered, slices

#: Bytes of text of a block; blocks whose places of a chunk stand in one row.
BLOCK, HOMES = 24 << 20, 4096
#: White space of one byte, and the last two bytes of longer ones (fixed by Unicode); what is wrongly
#: taken for white space only makes a chunk longer.
BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
BLANKS = [0xC285, 0xC2A0, 0x9A80, *range(0x8080, 0x808B), 0x80A8, 0x80A9, 0x80AF, 0x819F]
RESULT = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text, and at a space or line feed after a visible character."""
    start = (data == 32) | (data == 10)
    start[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(start)
    before, two = data[at - 1], data[at - 2].astype(np.int32) << 8 | data[at - 1]
    wide = before >= 0x80
    start[at[BLANK[before]]] = False
    start[at[wide][np.isin(two[wide], BLANKS)]] = False
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def packed(places: np.ndarray) -> bytes:
    """Small numbers in few bytes: their low bytes, the next ones and so on, compressed."""
    return pa.compress(np.ascontiguousarray(places.astype("<i4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<i4").ravel()


class Tokenizers:
    """Ids of chunks by a byte-level tokenizer (A) and a sentencepiece model (B), and their bytes."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        names = self.a.get_vocab()
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.a_bytes[k] = bytes(letters[c] for c in name) if all(c in letters for c in name) else name.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.lead = len(self.b.encode("a"))
        for token in (t.decode(errors="replace") for t in (*self.a_bytes, *self.b_bytes)):
            if any(y in " \n" and not x.isspace() for x, y in zip(token, token[1:])):
                raise ValueError(f"token {token!r} goes on into white space: texts of this tokenizer have no chunks")

    def encode(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        # B puts a space before what it gets, unless it gets nothing; a chunk that is not a space and more follows a letter that is taken off again.
        spaced = [len(c) > 1 and c.startswith(" ") for c in chunks]
        b = self.b.encode([c[1:] if s else "a" + c for c, s in zip(chunks, spaced)], num_threads=1)
        return a, [ids if s else ids[self.lead :] for ids, s in zip(b, spaced)]


@functools.cache
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def in_blocks(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, size: int) -> DataFrame:
    """``block, ids, counts, places, chunks, times``: documents, how many chunks each has, the places of
    these one after the other (``packed``), the distinct chunks, and how often each occurs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, 1, size):
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            data, offsets = utf8(pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))))
            starts = chunk_starts(data, offsets)
            bounds = np.append(starts, len(data)).astype(np.int64)
            found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
            times = np.bincount(found.indices.to_numpy(zero_copy_only=False), minlength=len(found.dictionary))
            common = np.argsort(-times, kind="stable")  # common chunks get small numbers
            rank = np.empty(len(common), dtype=np.int32)
            rank[common] = np.arange(len(common))
            places = rank[found.indices.to_numpy(zero_copy_only=False)]
            lists = [(batch.column(0), pa.int64()), (np.diff(np.searchsorted(starts, offsets)), pa.int32()), (found.dictionary.take(pa.array(common)).cast(pa.string()), pa.string()), (times[common], pa.int64())]
            whole = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, t)) for v, t in lists]
            yield pa.RecordBatch.from_arrays([whole[0], whole[1], pa.array([packed(places)], pa.binary()), whole[2], whole[3]], names=["ids", "counts", "places", "chunks", "times"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return scratch.numbered(rows.mapInArrow(cut, "ids array<long>, counts array<int>, places binary, chunks array<string>, times array<long>"), "block", "blocks")


def tokenized(chunks: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``number, times, homes, whole, a, b``: each chunk's tokens, and whether their bytes are the chunk's."""
    token = pa.struct([("id", pa.int32()), ("size", pa.int32())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        for batch in batches:
            for part in slices(batch, 1):
                texts = part.column(1).to_pylist()
                columns, raw, whole = [], [t.encode() for t in texts], np.ones(len(texts), dtype=bool)
                for ids, known in zip(both.encode(texts), (both.a_bytes, both.b_bytes)):
                    pieces = [[known[k] for k in own] for own in ids]
                    whole &= np.fromiter((b"".join(p) == r for p, r in zip(pieces, raw)), bool, len(raw))
                    flat = pa.StructArray.from_arrays([pa.array([k for own in ids for k in own], pa.int32()), pa.array([len(p) for own in pieces for p in own], pa.int32())], fields=list(token))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(own) for own in ids]))), pa.int32()), flat))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(whole), *columns], names=["number", "times", "homes", "whole", "a", "b"])

    kind = "array<struct<id:int,size:int>>"
    homes = chunks.schema["homes"].dataType.simpleString()
    return chunks.select("number", "chunk", "times", "homes").mapInArrow(encode, f"number long, times long, homes {homes}, whole boolean, a {kind}, b {kind}")


@contextmanager
def _in_place(spark: SparkSession) -> Iterator[None]:
    """Rows that are dealt by a part of a join's keys are joined where they are, and rows in order of
    their group are collected in that order."""
    settings = ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.execution.useObjectHashAggregateExec")
    before = [spark.conf.get(name, "true") for name in settings]
    for name in settings:
        spark.conf.set(name, "false")
    try:
        yield
    finally:
        for name, value in zip(settings, before):
            spark.conf.set(name, value)


def aligned(tokens: DataFrame) -> DataFrame:
    """``number, n_a, n_b, n_groups, links, groups`` from each text's tokens (``number, a, b``) of equal
    bytes: the linked ids in order, and the groups as ``a1,a2|b1;a3|b2,b3``."""
    sides = [tokens.select("number", F.posexplode(name).alias("pos", "token")) for name in "ab"]
    end = F.sum("token.size").over(W.partitionBy("number").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    a, b = (s.select("number", F.col("token.id").alias("id"), end.alias("end")) for s in sides)
    # A cut is where an A token and a B token end together: each side learns what it is linked to there.
    linked = [one.join(two.select("number", "end", F.col("id").alias("linked")), ["number", "end"], "left") for one, two in ((a, b), (b, a))]
    group = F.count("linked").over(W.partitionBy("number").orderBy("end").rowsBetween(W.unboundedPreceding, -1)).alias("group")
    listed = [F.array_sort(F.collect_list(F.struct("end", "group", "id", "linked"))).alias(name) for name in "ab"]
    a, b = (one.select("number", "end", "id", "linked", group).groupBy("number").agg(rows) for one, rows in zip(linked, listed))
    last = lambda name: lambda t, k: F.coalesce(F.get(name, k + 1)["group"] == t["group"], F.lit(False))
    ids = lambda name: F.split(F.array_join(F.transform(name, lambda t, k: F.concat(t["id"].cast("string"), F.when(last(name)(t, k), ",").otherwise(";"))), ""), ";")
    groups = F.array_join(F.filter(F.zip_with(ids("a"), ids("b"), lambda x, y: F.concat(x, F.lit("|"), y)), lambda g: g != "|"), ";")
    links = F.transform(F.filter("a", lambda t: t["linked"].isNotNull()), lambda t: F.struct(t["id"].alias("a"), t["linked"].alias("b")))
    size = lambda c: F.size(c).cast("long")
    return a.join(b, "number").select("number", size("a").alias("n_a"), size("b").alias("n_b"), size(links).alias("n_groups"), links.alias("links"), groups.alias("groups"))


def _spoiled(blocks: DataFrame, bad: DataFrame, shares: int) -> DataFrame:
    """``chunk, share, times``: how often chunks occur in documents that hold a ``bad`` one (by its text)."""
    listed = blocks.select("block", F.posexplode("chunks").alias("place", "chunk"))
    hit = listed.join(bad, "chunk", "left_semi").groupBy("block").agg(F.collect_list("place").alias("bad"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                counts, chunks, bad = (batch.column(k)[row].values for k in (0, 2, 3))
                counts = counts.to_numpy(zero_copy_only=False)
                places = unpacked(batch.column(1)[row].as_py(), int(counts.sum()))
                owner = np.repeat(np.arange(len(counts)), counts)
                ill = np.zeros(len(counts), dtype=bool)
                ill[owner[np.isin(places, bad.to_numpy(zero_copy_only=False))]] = True
                times = np.bincount(places[ill[owner]], minlength=len(chunks))
                used = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(4)[row].as_py()] * len(used), pa.int32()), chunks.take(pa.array(used)), pa.array(times[used], pa.int64())], names=["share", "chunk", "times"])

    ill = blocks.join(hit, "block").select("counts", "places", "chunks", "bad", _share(shares)).mapInArrow(count, "share int, chunk string, times long")
    return ill.groupBy("chunk", "share").agg(F.sum("times").alias("times"))


def _share(shares: int) -> Column:
    return F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share")


@dataclass(frozen=True)
class Alignment:
    """Documents' results; each linked pair of ids ``a, b`` with its count and whether it is its B id's
    highest; distinct chunks with their links and groups; and the blocks in which they occur."""

    documents: DataFrame
    pairs: DataFrame
    chunks: DataFrame
    blocks: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> Alignment:
    """Both tokenizers' tokens of each text, grouped at common ends and linked."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "alignment")
    blocks = in_blocks(docs, id_col, text_col, scratch, block)
    shares = -(-blocks.count() // HOMES) or 1
    listed = blocks.select("block", _share(shares), F.posexplode(F.arrays_zip("chunks", "times")).alias("place", "c"))
    homes = F.collect_list(F.struct(F.col("block").alias("home"), "place")).alias("homes")
    chunks = scratch.numbered(listed.groupBy(F.col("c.chunks").alias("chunk"), "share").agg(F.sum("c.times").alias("times"), homes), "number", "chunks")
    scratch.release()
    tokens = scratch.bucketed(tokenized(chunks, a_path, b_path), "number", "tokens")  # the alignment moves none of them
    whole = tokens.filter("whole")
    with _in_place(spark):
        facts = scratch.bucketed(aligned(whole.select("number", "a", "b")).join(whole.select("number", "times", "homes"), "number"), "number", "facts", dealt=True)
    links = facts.select("number", "times", F.explode("links").alias("link")).select("number", "times", "link.a", "link.b")
    counted = links
    if not tokens.filter("not whole").isEmpty():
        bad = tokens.filter("not whole").join(chunks, "number").select("chunk").distinct()
        minus = chunks.join(_spoiled(blocks, bad, shares).withColumnRenamed("times", "minus"), ["chunk", "share"]).select("number", "minus")
        counted = links.join(minus, "number", "left").withColumn("times", F.col("times") - F.coalesce("minus", F.lit(0))).filter("times > 0")
    counted = counted.groupBy("a", "b").agg(F.sum("times").alias("count"))
    pairs = scratch.table(counted.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("b"))), "pairs")
    scratch.drop("tokens")
    scratch.release()
    # One of a pair's tokens is the end of the other: there are at most as many pairs as bytes in both vocabularies.
    judged = links.join(F.broadcast(pairs), ["a", "b"], "left").groupBy("number").agg(F.count_if("best").alias("n_best"), F.coalesce(F.sum("count"), F.lit(0)).alias("count_sum"))
    known = facts.join(judged, "number")
    returned = known.select(F.explode("homes").alias("at"), "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups").select("at.home", "at.place", "n_a", "n_b", "n_groups", "n_best", "count_sum", "groups")
    listed = blocks.select("block", "ids", "counts", "places", F.size("chunks").alias("n"))
    documents = listed.groupBy("block").cogroup(returned.groupBy("home")).applyInArrow(_assembled, RESULT)
    return Alignment(documents, pairs, chunks.select("number", "chunk").join(known, "number"), blocks)


def _assembled(block: pa.Table, facts: pa.Table) -> pa.Table:
    """The documents of one block from the results of its chunks; one with a chunk that has none has no tokens."""
    row = block.select(["ids", "counts", "n"]).slice(0, 1)
    ids, counts = row["ids"].combine_chunks().flatten(), row["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
    places = unpacked(block["places"][0].as_py(), int(counts.sum()))
    n, at = row["n"][0].as_py(), facts["place"].to_numpy()
    have = np.zeros(n, dtype=bool)
    have[at] = True
    ends = np.cumsum(counts)
    starts = ends - counts

    def summed(values: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(values[places], dtype=np.int64)))
        return total[ends] - total[starts]

    good = (counts > 0) & (summed(have.astype(np.int64)) == counts)
    out = {"id": ids.cast(pa.int64())}
    for name in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"):
        values = np.zeros(n, dtype=np.int64)
        values[at] = facts["n_groups" if name == "n_links" else name].to_numpy()  # tokens that end together: one link a cut
        out[name] = pa.array(np.where(good, summed(values), 0))
    texts: list[bytes] = [b""] * n
    for k, text in zip(at.tolist(), facts["groups"].cast(pa.large_binary()).to_pylist()):
        texts[k] = text
    digests = [hashlib.sha256(b";".join([texts[k] for k in places[a:b].tolist()])).hexdigest() if g else "" for a, b, g in zip(starts.tolist(), ends.tolist(), good.tolist())]
    return pa.table({**out, "groups_sha256": pa.array(digests, pa.string())})


def digest(documents: DataFrame) -> DataFrame:
    return documents.withColumnRenamed("id", "doc_id")
