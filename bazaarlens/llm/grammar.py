"""Token-id shards compressed by Re-Pair grammars, with random access.

A shard holds consecutive documents' ids.  Frequent pairs of neighbouring symbols are replaced
by nonterminals, round after round, until none is frequent enough; a round replaces many pairs
at once, each where it does not overlap another.  No pair spans the end of a document, so every
document has symbols of its own.  A shard stores its rules in order, the expansion length of
each rule, its documents' symbol and token counts, and the symbols: enough to decode any
document, or any run of tokens, without the rest.

Shards are rows of a Parquet table in the shared folder (one row a shard, written by Spark's
own committer, so a lost executor's attempt leaves nothing behind), in ascending id order.

Defined results: a null or empty text is its end id alone; null ids come first; rows that share
an id are ordered by a hash of their texts; an empty table gives no rows; only the named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.llm.scratch import Scratch
from bazaarlens.llm.tokens import gather, gathered, tokenizer

#: Tokens after which a shard is closed; how often a pair must occur; rules a round may make.
SHARD_TOKENS, LEAST, PER_ROUND = 1 << 18, 8, 2048


def compress(ids: np.ndarray, base: int, end_id: int, least: int = LEAST, per_round: int = PER_ROUND) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (n x 2) of a shard; symbol base + i stands for rule i.  Rules beyond 16
    bits are made too, and kept if the shard is smaller with them although its symbols are wider.

    Replacing pairs only takes occurrences from other pairs, and the pairs it makes hold a new
    symbol.  So after the first round only places count whose pair was frequent before or whose
    neighbour is new: a pair is frequent exactly if it is frequent among these."""
    symbols, rules = ids.astype(np.uint32, copy=True), np.zeros((0, 2), dtype=np.uint32)
    narrow = base < 1 << 16  # while all symbols have 16 bits, a pair has 32
    short = None
    live = np.flatnonzero((symbols[:-1] != end_id) & (symbols[1:] != end_id))  # places of the pairs that count
    while len(live):
        if narrow and base + len(rules) == 1 << 16:
            short, narrow = (symbols.copy(), rules), False
        limit = min(per_round, (1 << 16) - base - len(rules)) if narrow else per_round
        a, b = symbols[live], symbols[live + 1]
        keys = (a << np.uint32(16) | b) if narrow else (a.astype(np.uint64) << np.uint64(32) | b)
        ordered = np.sort(keys)
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(heads, len(ordered)))
        often = np.flatnonzero(counts >= least)
        if len(often) == 0:
            break
        frequent = ordered[heads[often]]  # sorted
        rank = np.full(len(often), -1, dtype=np.int32)
        best = np.argsort(-counts[often], kind="stable")[:limit]
        rank[best] = np.arange(len(best), dtype=np.int32)
        slot = _places(frequent, keys)
        stays = slot >= 0
        live, slot = live[stays], rank[slot[stays]]
        hit = live[slot >= 0]
        slot = slot[slot >= 0]
        # Of hits one after the other, every second one: their pairs do not overlap.
        run = np.flatnonzero(np.concatenate(([True], hit[1:] != hit[:-1] + 1)))
        first = np.repeat(hit[run], np.diff(np.append(run, len(hit))))
        even = (hit - first) % 2 == 0
        hit, slot = hit[even], slot[even]
        chosen = frequent[best]
        shift, mask = np.array(16 if narrow else 32, chosen.dtype), np.array(0xFFFF if narrow else 0xFFFFFFFF, chosen.dtype)
        symbols[hit] = (base + len(rules) + slot).astype(np.uint32)
        rules = np.concatenate([rules, np.stack([chosen >> shift, chosen & mask], axis=1).astype(np.uint32)])
        # What is left counts on, and so do the places before and at a new symbol.
        counts_on, keep = np.zeros(len(symbols), dtype=bool), np.ones(len(symbols), dtype=bool)
        counts_on[live] = counts_on[hit] = True
        keep[hit + 1] = False
        symbols, counts_on = symbols[keep], counts_on[keep]
        new = np.flatnonzero(symbols >= base + len(rules) - len(chosen))
        counts_on[new[new > 0] - 1] = True
        counts_on &= symbols != end_id
        live = np.flatnonzero(counts_on[:-1] & (symbols[1:] != end_id))
    if short and 2 * len(short[0]) + 12 * len(short[1]) <= 4 * len(symbols) + 12 * len(rules):
        return short
    return symbols, rules


def _places(frequent: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key among the sorted ``frequent``, -1 if it is not there.  A table of 18
    bits of the keys' hashes answers most; only keys that share an entry are searched for."""
    table = np.full(1 << 18, -1, dtype=np.int32)
    bits = _bits(frequent)
    table[bits] = np.arange(len(frequent), dtype=np.int32)
    shared = np.flatnonzero(table[bits] != np.arange(len(frequent)))
    out = table[_bits(keys)]
    at = np.flatnonzero(out >= 0)
    wrong = at[frequent[out[at]] != keys[at]]
    out[wrong] = -1
    if len(shared) and len(wrong):
        found = np.minimum(np.searchsorted(frequent, keys[wrong]), len(frequent) - 1)
        out[wrong] = np.where(frequent[found] == keys[wrong], found, -1)
    return out


def _bits(keys: np.ndarray) -> np.ndarray:
    """18 well-mixed bits of each key."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(14)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)


def rule_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Tokens that each rule expands to.  A rule refers to earlier ones only."""
    lengths = np.zeros(len(rules), dtype=np.int64)
    open_ = np.ones(len(rules), dtype=bool)
    while open_.any():
        part = rules.astype(np.int64) - base
        size = np.where(part < 0, 1, lengths[np.maximum(part, 0)])
        ready = open_ & (size > 0).all(axis=1)
        lengths[ready] = size[ready].sum(axis=1)
        open_ &= ~ready
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """All tokens of ``symbols``: each rule is expanded once, then copied where it stands."""
    table = np.arange(len(rules), dtype=np.int64) + base
    sizes = np.ones(len(rules), dtype=np.int64)
    while len(deep := np.flatnonzero(table >= base)):  # one level of all rules at a time
        counts = np.ones(len(table), dtype=np.int64)
        counts[deep] = 2
        at = np.cumsum(counts) - counts
        grown = np.empty(int(counts.sum()), dtype=np.int64)
        grown[at] = table
        pair = rules[table[deep] - base].astype(np.int64)
        grown[at[deep]], grown[at[deep] + 1] = pair[:, 0], pair[:, 1]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.bincount(owner, weights=counts, minlength=len(sizes)).astype(np.int64)
        table = grown
    symbols = symbols.astype(np.int64)
    flat = np.concatenate([np.arange(base, dtype=np.uint32), table.astype(np.uint32)])
    starts = np.concatenate([np.arange(base), base + np.cumsum(sizes) - sizes])
    return gather(flat, starts, np.concatenate([np.ones(base, np.int64), sizes]), symbols)[0]


def read_tokens(shard: dict, start: int, stop: int) -> np.ndarray:
    """Tokens [start, stop) of a shard (a row as a dict): only the symbols that cover them are
    expanded, found by the stored expansion lengths."""
    symbols, rules, base = _symbols(shard), np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2), shard["base"]
    lengths = np.concatenate([np.frombuffer(shard["rule_lengths"], np.uint32), [1]]).astype(np.int64)
    ends = np.cumsum(lengths[np.where(symbols < base, -1, symbols.astype(np.int64) - base)])
    first, last = np.searchsorted(ends, [start, stop - 1], side="right")
    begin = ends[first - 1] if first else 0
    return expand(symbols[first : last + 1], rules, base)[start - begin : stop - begin]


def read_document(shard: dict, k: int) -> np.ndarray:
    """Tokens of a shard's k-th document, from its own symbols alone."""
    at = np.concatenate(([0], np.cumsum(shard["doc_symbols"])))
    return expand(_symbols(shard)[at[k] : at[k + 1]], np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2), shard["base"])


def _symbols(shard: dict) -> np.ndarray:
    return np.frombuffer(shard["symbols"], np.uint16 if shard["width"] == 2 else np.uint32)


def encode_shard(ids: list[np.ndarray], base: int, end_id: int) -> dict:
    """The stored columns of a shard but for document ids and place."""
    symbols, rules = compress(np.concatenate(ids), base, end_id)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    # The end id may stand inside a document too: a document ends where its tokens do.
    lengths = np.append(rule_lengths(rules, base), 1)
    reach = np.cumsum(lengths[np.where(symbols < base, -1, symbols.astype(np.int64) - base)])
    ends = np.searchsorted(reach, np.cumsum([len(i) for i in ids])) + 1
    return {
        "base": base, "width": width, "n_tokens": int(sum(map(len, ids))), "doc_tokens": [len(i) for i in ids], "doc_symbols": np.diff(ends, prepend=0).tolist(),
        "rules": rules.tobytes(), "rule_lengths": lengths[:-1].astype(np.uint32).tobytes(), "symbols": symbols.astype(np.uint16 if width == 2 else np.uint32).tobytes(),
    }


def write_shards(docs: DataFrame, tokenizer_path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode all documents in id order and return the table of written shards: part and
    first_token (tokens of the part before the shard) place it in the order."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"part int, first_token long, doc_ids array<{kind}>, base int, width int, n_tokens long, doc_tokens array<int>, doc_symbols array<int>, "
              "rules binary, rule_lengths binary, symbols binary")

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        names, ids, waiting, kinds = [], [], 0, None

        def close() -> pa.RecordBatch:
            nonlocal names, ids, waiting, done
            row = {"part": part, "first_token": done, "doc_ids": names} | encode_shard(ids, base, end_id)
            done += row["n_tokens"]
            names, ids, waiting = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

        for piece in gathered(batches, 1):
            words = tokenizer(tokenizer_path, end_id)
            base = words.library.get_vocab_size()
            kinds = [pa.int32(), pa.int64(), pa.list_(piece.schema.field(0).type), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.binary()] * 3]
            flat, offsets = words.encode(piece.column(1))
            for name, a, b in zip(piece.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                names.append(name)
                ids.append(flat[a:b])
                waiting += b - a
                if waiting >= shard_tokens:
                    yield close()
        if ids:
            yield close()

    # Rows of one id are dealt on by text and place, so that no task holds all rows of a common id or of none.
    text = F.col(text_col).cast("string")
    ordered = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("print"), F.monotonically_increasing_id().alias("row"))
    ordered = ordered.repartitionByRange("id", "print", "row").sortWithinPartitions("id", "print", "row").select("id", "text")
    return scratch.table(ordered.mapInArrow(batches, schema), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document, decoded from its shard: id, start (tokens of all documents before
    it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))  # a row for each task that wrote
    parts = parts.select("part", (F.sum("part_tokens").over(W.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_type = batch.schema.field("doc_ids").type.value_type
            for k in range(batch.num_rows):
                (shard,) = batch.slice(k, 1).to_pylist()
                ids = expand(_symbols(shard), np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2), shard["base"])
                n = np.array(shard["doc_tokens"], dtype=np.int64)
                starts = np.cumsum(n) - n
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(starts, len(ids)).astype(np.int32) * np.int32(4)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(shard["doc_ids"], id_type), pa.array(starts + shard["first_token"] + shard["part_start"]), pa.array(n), data], names=["id", "start", "n_tokens", "ids"])

    placed = shards.join(F.broadcast(parts), "part")
    return placed.mapInArrow(batches, f"id {kind}, start long, n_tokens long, ids binary")


def digest(read: DataFrame) -> DataFrame:
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
