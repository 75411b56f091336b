from __future__ import annotations

import pytest

#: Texts that every operator must take: nulls, empty, blank, ties, repeats, odd characters, long.
EDGE = [
    (1, "the cat sat on the mat and the dog ran off", "a"), (2, None, "a"), (3, "", None), (4, "   \n\t ", "b"), (5, "one", "b"),
    (6, "the cat sat on the mat and the dog ran off", "b"), (6, "the cat sat on the mat and the dog ran off", "b"), (None, "no id here, but a text of some words", "c"),
    (7, "é ß 漢字 " * 40, "c"), (8, "word" * 3000 + " " + "tail " * 2000, None), (9, "x. y! z?\n\nx. y! z?\n", "a"),
]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """Edge texts in a file, with extra columns of names that operators use inside."""
    path = str(tmp_path_factory.mktemp("edge"))
    rows = [(i, t, s, "de", len(t or ""), 1, "k", [1]) for i, t, s in EDGE]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, row int, id string, spans array<int>").coalesce(2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
