from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from bazaarlens.llm import grammar, packing
from bazaarlens.llm.scratch import Scratch
from bazaarlens.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    library = Tokenizer.from_file(PATH)
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 1]


WORDS = WordTokenizer(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="ab ,.'<|>end\n1İßÉéﬁ가", max_size=60)), max_size=6))
def test_words_give_the_ids_of_whole_texts(texts):
    ids, offsets = WORDS.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*WORDS.library.encode(text or "", add_special_tokens=False).ids, 1]


#: Letters that normalising turns into a letter and a mark, in plain words of their languages.
COMPOSED = "\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f\u09dc\u09dd\u09df\u0a33\u0a36\u0a59\u0a5a\u0a5b\u0a5e\u0b5c\u0b5d"
MARKED = "\u0130\u01f0\u0390\u0301\u0323\u200d"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=COMPOSED + MARKED + "\u0915\u093e\u0995\u0a15\u0b15\u1100\u1161aB1 .,'\"#<|>_-", max_size=40), max_size=5))
def test_words_of_scripts_with_composed_letters(texts):
    ids, offsets = WORDS.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*WORDS.library.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("tail", [".", ",", "'", '"', "s'##."])
def test_every_code_point_before_punctuation(tail):
    chars = [chr(c) for c in range(0x20, 0x11000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(chars), 4096):
        texts = [f"a{c}{tail} {c}{tail}" for c in chars[at : at + 4096]]
        ids, offsets = WORDS.encode(pa.array(texts))
        want = WORDS.library.encode_batch(texts, add_special_tokens=False)
        assert [t for k, t in enumerate(texts) if ids[offsets[k] : offsets[k + 1]].tolist() != [*want[k].ids, 1]] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(2, 9), max_size=60), min_size=1, max_size=8), st.sampled_from([10, 70_000]))
def test_grammar_round_trip_and_random_access(docs, base):
    ids = [np.array([*d, 1], dtype=np.uint32) for d in docs]
    shard = grammar.encode_shard(ids, base, 1)
    rules = np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2)
    flat = np.concatenate(ids)
    assert np.array_equal(grammar.expand(grammar._symbols(shard), rules, base), flat)
    for k, own in enumerate(ids):
        assert np.array_equal(grammar.read_document(shard, k), own)
    a, b = len(flat) // 3, max(len(flat) // 3 + 1, 2 * len(flat) // 3)
    assert np.array_equal(grammar.read_tokens(shard, a, b), flat[a:b])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 5), max_size=60), min_size=1, max_size=8), st.sampled_from([10, 70_000]))
def test_grammar_reads_documents_that_hold_the_end_id(docs, base):
    ids = [np.array([*d, 1], dtype=np.uint32) for d in docs]
    shard = grammar.encode_shard(ids, base, 1)
    assert len(shard["doc_symbols"]) == len(ids)
    for k, own in enumerate(ids):
        assert np.array_equal(grammar.read_document(shard, k), own)


def test_grammar_finds_repeats():
    ids = np.array(([5, 6, 7, 8] * 500 + [1]) * 4, dtype=np.uint32)
    symbols, rules = grammar.compress(ids, 49408, 1)
    assert len(symbols) < len(ids) / 8 and len(rules)
    assert grammar.rule_lengths(rules, 49408).max() >= 8


def test_grammar_goes_on_until_no_pair_is_frequent():
    ids = np.concatenate([np.append(np.arange(2, 402), 1)] * 300).astype(np.uint32)
    for base in (49408, (1 << 16) - 50):  # the second needs rules beyond 16 bits
        symbols, rules = grammar.compress(ids, base, 1)
        assert len(symbols) == 2 * 300 and grammar.rule_lengths(rules, base).max() == 400  # one rule and the end id a copy
        assert np.array_equal(grammar.expand(symbols, rules, base), ids)
    noise = np.random.default_rng(2).integers(2, 200, 1 << 17).astype(np.uint32)
    symbols, rules = grammar.compress(noise, (1 << 16) - 50, 1)  # wider symbols would cost more than rules save
    assert len(rules) == 50 and np.array_equal(grammar.expand(symbols, rules, (1 << 16) - 50), noise)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 6), max_size=200), min_size=1, max_size=6), st.sampled_from([10, (1 << 16) - 3, 70_000]), st.integers(1, 4))
def test_grammar_leaves_no_frequent_pair(docs, base, per_round):
    ids = np.concatenate([np.array([*d, 1], dtype=np.uint32) for d in docs])
    symbols, rules = grammar.compress(ids, base, 1, per_round=per_round)
    assert np.array_equal(grammar.expand(symbols, rules, base), ids)
    if base == (1 << 16) - 3 and len(rules) == 3:
        return  # more rules would have cost more than they save
    found, last = {}, {}
    for k, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist())):
        if 1 not in pair and last.get(pair) != k - 1:  # occurrences that do not overlap
            found[pair], last[pair] = found.get(pair, 0) + 1, k
    assert max(found.values(), default=0) < grammar.LEAST


def test_shards_of_edge_texts(spark, edge, empty, whole):
    got = grammar.digest(grammar.read_shards(grammar.write_shards(edge, PATH, Scratch(spark, "t"), shard_tokens=500))).collect()
    rows = sorted(edge.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    start, want = 0, []
    for r in rows:
        ids = np.array(whole(r["text"]), dtype="<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert grammar.read_shards(grammar.write_shards(empty, PATH, Scratch(spark, "t"))).count() == 0


def test_fill_is_closest():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 40, 4)}
        room = int(rng.integers(1, 90))
        best = max(s for n in itertools.product(*[range(c + 1) for c in counts.values()]) if (s := sum(a * b for a, b in zip(n, counts))) <= room)
        picked = packing.fill(counts, room)
        assert sum(k * n for k, n in picked.items()) == best and all(n <= counts[k] for k, n in picked.items())


@pytest.mark.parametrize("length", [1100, 700, 1])
def test_equal_remainders_are_packed_with_little_padding(length):
    packer = packing.Packer(2048, 0)
    for doc in range(6000):
        packer.add(doc, np.arange(length, dtype=np.uint32) + np.uint32(doc))
    packer.pack(0)
    sizes, found = {}, {}
    for doc, start, n, _, sequence, _, ids in packer.take_rows():
        sizes[sequence] = sizes.get(sequence, 0) + n
        found.setdefault(doc, []).append((start, ids))
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values()) <= 0.02 * 6000 * length and max(sizes.values()) <= 2048
    assert all(b"".join(ids for _, ids in sorted(found[d])) == (np.arange(length, dtype=np.uint32) + np.uint32(d)).tobytes() for d in range(6000))


def test_packing_holds_every_id_once(edge, empty, whole):
    got = packing.pack(edge, PATH, window=256).collect()
    sizes, place = {}, {}
    for r in got:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert max(sizes.values()) <= 256
    for pieces in place.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    pad = sum(0 if n & (n - 1) == 0 else 256 - n for n in sizes.values())
    assert pad <= 0.02 * sum(sizes.values()) + 64
    tokens = sorted(t for r in got for t in np.frombuffer(r["ids"], "<u4").tolist())
    assert tokens == sorted(t for r in edge.collect() for t in whole(r["text"]))
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["start"] + r["length"] <= r["doc_tokens"]
    assert packing.pack(empty, PATH).count() == 0
