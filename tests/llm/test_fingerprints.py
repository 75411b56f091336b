from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from bazaarlens.llm import fingerprints
from bazaarlens.llm.queries import QUERIES


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, got, tolerance=0.12):
    """``rows``: id and text in order; ``got``: result rows by id, ids being distinct."""
    prints, errors = {}, []
    for k, (i, text) in enumerate(rows):
        text, after, r = text or "", rows[(k + 1) % len(rows)][1] or "", got[i]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r["near_edited"] - jaccard(text, edited), r["near_next"] - jaccard(text, after)]
        for t, f in ((text, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(t, f) == f and (f == "") == (not shingles(t))
    assert np.abs(errors).max() < tolerance and abs(np.mean(errors)) < 0.02


def test_edge_texts(spark, edge, empty):
    docs = edge.filter("doc_id <> 6 or doc_id is null").unionByName(edge.filter("doc_id = 6").limit(1))
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    got = {r["id"]: r for r in fingerprints.edited_pairs(docs.repartition(3)).collect()}
    assert len(got) == len(rows)
    check(rows, got, 0.2)
    assert fingerprints.edited_pairs(empty).count() == 0
    assert fingerprints.edited_pairs(edge).count() == 11  # repeated ids: a row each
    (one,) = fingerprints.edited_pairs(edge.filter("doc_id = 1")).collect()
    assert one["near_next"] == 1.0


def test_query_equals_brute_force(spark, sf):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    out = QUERIES["op11_one_permutation_fingerprints"](spark, sf)
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    check(rows, {r["doc_id"]: r for r in out.collect()})


@pytest.mark.parametrize("n", [1, 3, 20, 300, 5000])
def test_likeness_has_no_bias(n):
    rng = np.random.default_rng(n)
    errors = []
    for same in (0.0, 0.5, 0.9):
        for _ in range(30):
            k = int(same * n)
            sets = [[f"w{x}" for x in rng.integers(0, 2**60, 5 * n)] for _ in range(2)]
            minima = []
            common = rng.integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2)
            for _ in sets:
                h = np.concatenate([common, rng.integers(0, 2**63, n - k, dtype=np.uint64) * np.uint64(2)])
                row = np.full(fingerprints.BINS, fingerprints.EMPTY)
                np.minimum.at(row, (h >> np.uint64(64 - 9)).astype(int), h)
                minima.append(row[None])
            a, b = ([p.tobytes() for p in fingerprints.packed(fingerprints.densified(m))] for m in minima)
            errors.append(fingerprints.likeness(a, b)[0] - k / (2 * n - k))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < (0.3 if n < 10 else 0.13 if n < 100 else 0.06)


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 900, n)) + tail for n, tail in ((4000, " "), (3, ""), (900, "\n\n"), (30, " " + "x" * 5000))])
    whole = fingerprints.fingerprints(texts)
    for limit in (64, 700):
        data = np.frombuffer(texts[0].as_py().encode(), np.uint8)
        assert len(list(fingerprints.pieces(data, limit))) > 5
        monkeypatch.setattr(fingerprints.pieces, "__defaults__", (limit,))
        assert fingerprints.fingerprints(texts) == whole
