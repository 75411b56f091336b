"""Token ids of whole texts, by a word memo in front of the tokenizers library.

A tokenizer whose pre-tokenizer drops white space and merges within pre-tokens only gives a
text the ids of its white-space separated words, one after the other.  So each Arrow slice is
split into words, its distinct words are looked up in a memo that lives as long as the Python
worker, and only new words reach the library.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once (arrays of eight bytes a byte hang on each), that are
#: encoded at once, and words in each of the memo's two generations.
HASH_BYTES, SLICE_BYTES, MEMO_WORDS = 1 << 20, 4 << 20, 400_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def slices(batch: pa.RecordBatch, column: int, limit: int = HASH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def gathered(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows again, in pieces of about ``limit`` bytes of text."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices(batch, column, limit):
            waiting.append(part)
            size += part.column(column).nbytes
            if size >= limit * 0.75:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting, size = [], 0
    if waiting and (rows := pa.Table.from_batches(waiting).combine_chunks().to_batches()):
        yield rows[0]
    pa.default_memory_pool().release_unused()  # the worker goes on to other tasks


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat[starts[i]:starts[i] + counts[i]]`` for each i of ``picks``, laid end to end, and
    the n + 1 offsets of these runs."""
    n = counts[picks]
    offsets = np.zeros(len(picks) + 1, dtype=np.int64)
    np.cumsum(n, out=offsets[1:])
    at = np.repeat(starts[picks] - offsets[:-1], n)
    at += np.arange(len(at))
    return flat[at], offsets


class WordTokenizer:
    """Ids of texts by the tokenizer file ``path``, with ``end_id`` after each text."""

    def __init__(self, path: str, end_id: int = 1) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.end = np.array([end_id], dtype=np.uint32).tobytes()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cuts: dict[str, bool] = {}

    def _cut_after(self, letter: str) -> bool:
        """Whether punctuation after this character is a pre-token of its own.  The library is
        asked, as a letter may be normalised into one and a mark, which the punctuation joins."""
        if letter not in self.cuts:
            normal = self.library.normalizer.normalize_str(letter + ".")
            self.cuts[letter] = letter.isalnum() and [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)][-1] == "."
        return self.cuts[letter]

    def _learn(self, words: list[str]) -> None:
        """Encode new words: those of small ASCII letters by the model itself, as nothing before
        it changes them; other words of letters as one text with spaces between, where each must
        come back as one pre-token; the rest as words, or alone if they may hold special tokens."""
        plain = [w for w in words if w.isascii() and w.isalpha() and w.islower()]
        model = self.library.model
        for word in plain:
            self.young[word] = array("I", [t.id for t in model.tokenize(word)]).tobytes()
        words = [w for w in words if w not in self.young] if len(plain) < len(words) else []
        letters = [w for w in words if w.isalpha()]
        for k in range(0, len(letters), 1024):
            part = letters[k : k + 1024]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            if not self._store(part, found, all_letters=True):
                self._store(part, self.library.encode(part, is_pretokenized=True, add_special_tokens=False))
        others = [w for w in words if not w.isalpha() and "<|" not in w]
        self._store(others, self.library.encode(others, is_pretokenized=True, add_special_tokens=False))
        for word in words:
            if "<|" in word:
                self.young[word] = np.array(self.library.encode(word, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def _store(self, words: list[str], found: object, all_letters: bool = False) -> bool:
        """Keep the ids of each word; false if the library did not find these words."""
        owner = np.array(found.word_ids, dtype=np.int64)
        if len(owner) and owner[-1] >= len(words):
            return False
        bounds = np.searchsorted(owner, np.arange(len(words) + 1)) * 4
        if all_letters and (bounds[1:] == bounds[:-1]).any():
            return False
        data = np.array(found.ids, dtype=np.uint32).tobytes()
        for word, a, b in zip(words, bounds[:-1].tolist(), bounds[1:].tolist()):
            self.young[word] = data[a:b]
        return True

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Ids of each of these distinct words, from the memo or the library."""
        out = list(map(self.young.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        if missing:
            new = []
            for k in missing:
                if (ids := self.old.get(words[k])) is None:
                    new.append(words[k])
                else:
                    self.young[words[k]] = ids
            self._learn(new)
            for k in missing:
                out[k] = self.young[words[k]]
        if len(self.young) > MEMO_WORDS:
            self.old, self.young = self.young, {}
        return out

    def _parts(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word as the part that is looked up and the punctuation after it (or null): the
        library makes a pre-token of its own of ASCII punctuation after a letter or digit.
        In words of ASCII, small letters are what counts."""
        stems = pc.utf8_rtrim(words, characters=PUNCTUATION)
        last = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
        able = np.array([c != "" and self._cut_after(c) for c in last.dictionary.to_pylist()], dtype=bool)
        sizes = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        cut = able[last.indices.to_numpy(zero_copy_only=False)] & (pc.binary_length(words).to_numpy(zero_copy_only=False) > sizes)
        cut &= ~pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        tails = [w[n:] for w, n in zip(pc.cast(words.filter(pa.array(cut)), pa.large_binary()).to_pylist(), sizes[cut].tolist())]
        place = np.full(len(words), -1, dtype=np.int64)
        place[cut] = np.arange(len(tails))
        keys = pc.if_else(pa.array(cut), stems, words)
        keys = pc.if_else(pc.string_is_ascii(keys), pc.ascii_lower(keys), keys)
        return keys, pa.array(tails, pa.large_binary()).cast(pa.large_string()).take(pa.array(place, mask=place < 0))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) end to end, and each text's n + 1 offsets."""
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        keys, tails = (x.dictionary_encode() for x in self._parts(coded.dictionary))
        ids = self._lookup(keys.dictionary.to_pylist()) + self._lookup(tails.dictionary.to_pylist()) + [b""]
        # A word is its key's ids and its tail's: where it has no tail, the empty one at the end.
        tail = tails.indices.fill_null(len(tails.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) + len(keys.dictionary)
        both = np.stack([keys.indices.to_numpy(zero_copy_only=False), tail], axis=1).ravel()
        flat, bounds = self._gathered(ids, both)
        flat, bounds = np.append(flat, np.frombuffer(self.end, np.uint32)), np.append(bounds[::2], len(flat) + 1)
        lengths = np.asarray(split.value_lengths()).astype(np.int64)
        rows = np.cumsum(lengths)
        picks = np.insert(coded.indices.to_numpy(zero_copy_only=False), rows, len(coded.dictionary))
        out, offsets = gather(flat, bounds[:-1], np.diff(bounds), picks)
        return out, np.concatenate(([0], offsets[rows + np.arange(1, len(rows) + 1)]))

    @staticmethod
    def _gathered(ids: list[bytes], picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return gather(np.frombuffer(b"".join(ids), dtype=np.uint32), np.cumsum(counts) - counts, counts, picks)


@functools.cache
def tokenizer(path: str, end_id: int = 1) -> WordTokenizer:
    """The worker's one tokenizer for a file: its memo serves all tasks of that worker."""
    return WordTokenizer(path, end_id)
