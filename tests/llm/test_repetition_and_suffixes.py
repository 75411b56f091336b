from __future__ import annotations

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from bazaarlens.llm import mixing, near_dedup, repetition, suffix_dedup
from bazaarlens.llm.scratch import Scratch
from bazaarlens.llm.tokens import slices


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    marks = [False] * len(words)
    for k in range(len(words) - 2):
        if seen[tuple(words[k : k + 3])] > 1:
            marks[k] = marks[k + 1] = marks[k + 2] = True
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(marks)


def test_counts_and_verdicts(spark, edge, empty):
    rng = random.Random(2)
    varied = " ".join("".join(rng.choice("abcdefghijkl") for _ in range(5)) for _ in range(200))
    texts = [varied, "\n".join([varied[:300]] * 6), "a b c d e f g h i j " * 30, "x#|<> y\n\nx#|<> y\n z\n z", varied + "\n" + varied[:80]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in repetition.digest(repetition.score(df)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert [got[i]["kept"] for i in range(5)] == [True, False, False, False, True]
    for r, s in zip(sorted(repetition.score(edge).collect(), key=str), range(99)):
        text = next((e["text"] for e in edge.collect() if e["doc_id"] == r["id"]), None)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(text)
    assert repetition.score(empty).count() == 0


def coverage(text, lengths):
    """Shares of word characters in lines that repeat and in n-word windows that repeat."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    whole, lines, dup = max(1, sum(map(len, words))), set(), 0
    for line in (text or "").split("\n"):
        dup += sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", line))) if line in lines else 0
        lines.add(line)
    grams = []
    for n in lengths:
        windows = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
        seen, inside = collections.Counter(windows), set()
        for k, w in enumerate(windows):
            if seen[w] > 1:
                inside |= set(range(k, k + n))
        grams.append(sum(len(words[k]) for k in inside) / whole)
    return dup / whole, grams


@pytest.mark.parametrize("seed", range(6))
def test_coverage_and_verdict_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé#") for _ in range(rng.randint(1, 5)))
    texts = [None, "", "\n\n", " \n a"]
    for _ in range(60):
        lines = [" ".join(word() for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 12))]
        lines += [rng.choice(lines) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 6))]
        rng.shuffle(lines)
        texts.append(rng.choice(["\n", "\n\n", " ", "\r\n"]).join(lines))
    *counts_, line, grams = repetition.measure(pa.array(texts))
    got = {r["doc_id"]: r for r in repetition.digest(repetition.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()} if seed == 0 else {}
    for k, text in enumerate(texts):
        assert tuple(int(c[k]) for c in counts_) == counts(text)
        want_line, want_grams = coverage(text, repetition.LIMITS)
        assert line[k] == pytest.approx(want_line) and grams[k].tolist() == pytest.approx(want_grams)
        if got:
            n_words, *_, repeat = counts(text)
            failed = n_words < 50 or 100 * repeat > 50 * n_words
            over = want_line > repetition.LINE_LIMIT or any(g > most for g, most in zip(want_grams, repetition.LIMITS.values()))
            assert got[k]["kept"] == (not failed and not over)


def test_memory_goes_by_bytes_not_rows():
    texts = pa.array(["word " * 20_000 + str(k) for k in range(40)])
    assert max(part.column(0).nbytes for part in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), 0)) <= 1 << 20


def brute(rows):
    seen, out = set(), []
    for d, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            window = raw[s : s + 100]
            if window in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((d, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("limit", "common", "sample"), [(100_000, 1 << 14, 64), (3, 1 << 14, 64), (100_000, 4, 64), (3, 9, 1), (100_000, 4, 2)])
def test_removed_bytes_equal_brute_force(spark, tmp_path, limit, common, sample):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 160, 400)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages)[rng.randint(0, 5) :], text(rng.randint(0, 40))]
        rows.append((i, "".join(parts)))
    rows += [(60, "ab" * 300), (61, "z" * 250), (62, None), (63, ""), (64, rows[3][1]), (65, "b" + "ab" * 90)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = suffix_dedup.digest(suffix_dedup.removed(spark.read.parquet(str(tmp_path / "d")), group_limit=limit, common=common, sample=sample)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))


def test_reads_split_otherwise_give_the_same_rows(spark, tmp_path, monkeypatch):
    """Between any two reads of a run the files' splits change, as they do when cores come and go."""
    rng, n = random.Random(3), [0]
    base = "".join(rng.choice("abcdefg ") for _ in range(300))
    rows = [(i, base[: 150 + i] if i % 3 == 0 else "".join(rng.choice("abcdefg ") for _ in range(200)), f"s{i % 4}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(str(tmp_path / "d"))
    write = Scratch.table

    def table(self, *args, **options):
        n[0] += 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", ["128m", "3k", "9k"][n[0] % 3])
        spark.conf.set("spark.sql.files.openCostInBytes", ["4m", "1", "1k"][n[0] % 3])
        return write(self, *args, **options)

    monkeypatch.setattr(Scratch, "table", table)
    docs = spark.read.parquet(str(tmp_path / "d"))
    try:
        assert sorted(map(tuple, suffix_dedup.digest(suffix_dedup.removed(docs)).collect())) == sorted(brute([r[:2] for r in rows]))
        near = {r["doc_id"]: r["kept"] for r in near_dedup.digest(near_dedup.groups(docs)).collect()}
        assert {r["doc_id"] for r in near_dedup.deduplicated(docs).collect()} == {d for d, kept in near.items() if kept}
        taken = {r["id"]: r["taken"] for r in mixing.mix(docs, block=16).collect() if r["taken"]}
        got = {}
        for r in mixing.mixed_documents(docs, block=16).collect():
            got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
        assert got == taken and n[0] > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_edges(edge, empty):
    rows = sorted(((r["doc_id"], r["text"]) for r in edge.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = suffix_dedup.digest(suffix_dedup.removed(edge)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)
    assert suffix_dedup.digest(suffix_dedup.removed(empty)).count() == 0
