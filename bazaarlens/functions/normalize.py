"""Text normalisation for both sides of a match, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bazaarlens.functions import terms as t


def has_arabic(text: Column) -> Column:
    return text.rlike("[؀-ۿ]")


def fold(text: Column) -> Column:
    """One form for digits and letters that are typed for one another; no marks."""
    digits = F.translate(text, t.ARABIC_DIGITS, "0123456789" * 2)
    return F.translate(F.regexp_replace(digits, t.ARABIC_MARKS, ""), t.ARABIC_FROM, t.ARABIC_TO)


def transliterate(text: Column) -> Column:
    """Known Arabic terms, with or without the article, as the words that rules know.  A term is
    replaced where it is a whole run of letters (or, with a space in it, two whole runs)."""
    for term, word in t.ARABIC_TERMS.items():
        if " " in term:
            text = F.regexp_replace(text, rf"(?<!\p{{L}})(?:{t.ARTICLE})?{term}(?!\p{{L}})", word)
    words = F.create_map(*[F.lit(x) for pair in t.ARABIC_TERMS.items() for x in pair])
    runs, gaps = F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0)), F.split(text, r"\p{L}+", -1)
    bare = lambda w: F.when(F.startswith(w, F.lit(t.ARTICLE)), F.substring(w, len(t.ARTICLE) + 1, 1000))
    put = F.transform(runs, lambda w: F.coalesce(words[w], words[bare(w)], w))
    return F.array_join(F.zip_with(gaps, put, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def prepare(text: Column) -> Column:
    """Latin text as it is; other text folded and transliterated."""
    return F.when(has_arabic(text), transliterate(fold(text))).otherwise(text)


def normalize(text: Column) -> Column:
    """Small letters, Arabic prepared, "+" as a word, punctuation and runs of space as one space."""
    text = F.replace(prepare(F.lower(text)), F.lit("+"), F.lit(" plus "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def expand_prefix(text: Column) -> Column:
    """Type-ahead only: the last word of Arabic text, if it begins terms of exactly one meaning,
    becomes that meaning.  Other text is as it was."""
    words = F.split(F.trim(F.regexp_replace(fold(text), r"(?U)\s+", " ")), " ")
    last = F.element_at(words, -1)
    known = F.array(*[F.struct(F.lit(k).alias("term"), F.lit(v).alias("word")) for k, v in t.ARABIC_TERMS.items()])
    meant = F.array_distinct(F.transform(F.filter(known, lambda x: F.startswith(x["term"], last)), lambda x: x["word"]))
    complete = (F.length(last) >= 2) & ~last.isin(*t.ARABIC_TERMS) & (F.size(meant) == 1)
    swapped = F.when(complete, F.concat(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(meant, 1, 1))).otherwise(words)
    return F.when(has_arabic(text), F.array_join(swapped, " ")).otherwise(text)


def contains_folded(value: Column, term: Column) -> Column:
    """Substring test without case; no character of the term is a wildcard."""
    return F.contains(F.lower(value), F.lower(term))
