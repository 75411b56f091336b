from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from bazaarlens.llm import alignment
from bazaarlens.llm.queries import BYTE_LEVEL, PIECES, QUERIES


def brute(rows):
    """Results of whole texts by the libraries, without chunks."""
    both, seen, links = alignment.tokenizers(BYTE_LEVEL, PIECES), [], Counter()
    for i, text in rows:
        raw, groups, own = (" " + (text or "")).encode(), [], []
        a = both.a.encode(" " + (text or ""), add_special_tokens=False).ids
        b = both.b.encode(text or "")
        if not text or b"".join(both.a_bytes[k] for k in a) != raw or b"".join(both.b_bytes[k] for k in b) != raw:
            seen.append((i, 0, 0, [], []))
            continue
        ends = []
        for ids, known in ((a, both.a_bytes), (b, both.b_bytes)):
            at, out = 0, []
            for k in ids:
                at += len(known[k])
                out.append((at, k))
            ends.append(out)
        x, y, cuts = 0, 0, sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
        for cut in cuts:
            ga, gb = [], []
            while x < len(a) and ends[0][x][0] <= cut:
                ga.append(ends[0][x][1])
                x += 1
            while y < len(b) and ends[1][y][0] <= cut:
                gb.append(ends[1][y][1])
                y += 1
            groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
            own.append((ga[-1], gb[-1]))
        links.update(own)
        seen.append((i, len(a), len(b), groups, own))
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    return [(i, na, nb, len(g), len(own), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, g, own in seen]


def plain(rows):
    return sorted(map(str, map(tuple, rows)))


ODD = ["<|endoftext|> and <s> are text </s>", "a\n\n  b\t c\r\nd", " leads  with  spaces ", "\nline first", "naïve café déjà vu 　x", "▁ is not a space", "bars ▁▂▃ and then words", "don't  we'll\n\t they've  ", "日本語のテキスト 漢字", "\x00 nul \x1c sep", "emoji 👩‍👩‍👧 👍🏽 x", "  ", "x" * 5000 + " y", "tab\tonly\ttext", "é combining   line", "<0x41> <unk> <s>"]


def test_texts_are_aligned_as_by_brute_force(spark, edge):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(i, t) for i, t in enumerate(ODD, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge.select("doc_id", "text")).repartition(3)
    got = alignment.align(docs, BYTE_LEVEL, PIECES, block=200).documents.collect()
    assert plain(got) == plain(brute([(r["doc_id"], r["text"]) for r in docs.collect()]))
    zero = [r for r in got if r["id"] == 5]
    assert len(zero) == 2 and sorted(r["n_a"] > 0 for r in zero) == [False, True]  # one holds U+2581, the edge text does not


def test_query_equals_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = QUERIES["op13_tokenizer_alignment"](spark, sf)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert plain(out.collect()) == plain(brute(rows))


def test_pairs_are_ends_of_one_another(spark, sf):
    both = alignment.tokenizers(BYTE_LEVEL, PIECES)
    found = alignment.align(spark.read.parquet(f"{sf}/documents.parquet"), BYTE_LEVEL, PIECES).pairs.collect()
    assert found and all(both.a_bytes[r["a"]].endswith(both.b_bytes[r["b"]]) or both.b_bytes[r["b"]].endswith(both.a_bytes[r["a"]]) for r in found)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")]])
def test_nothing_to_align(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [tuple(r) for r in alignment.align(docs, BYTE_LEVEL, PIECES).documents.collect()] == [(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows]
