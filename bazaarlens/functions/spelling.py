"""Spelling correction of queries against the words that rules know.

Distinct query words meet the vocabulary on what is left of both without one or two letters, and
only what meets is measured; the text is put together again from the corrected words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.functions import terms as t
from bazaarlens.functions.normalize import fold, has_arabic
from bazaarlens.functions.parse import CATEGORIES

WORD = r"(?U)\p{L}+"


def vocabulary() -> list[str]:
    """Single words of three letters or more, without digits, that a rule reads as such."""
    phrases = [*t.BRAND_WORDS, *t.BRAND_LINES, *t.COLOUR_WORDS, *t.COLOUR_NAMES, *t.PHONE_VARIANTS, *t.LAPTOP_VARIANTS,
               *t.RESOLUTION_WORDS, *t.RESOLUTION_NAMES, *t.PANEL_WORDS, *t.PANEL_NAMES, *[w for c in CATEGORIES for w in (*c.words, *c.brands)]]
    words = {w for p in phrases for w in p.split()}
    return sorted(w for w in words if len(w) >= 3 and not any(ch.isdigit() for ch in w))


def arabic_vocabulary() -> dict[str, str | None]:
    """Folded words of Arabic terms, and the meaning of those that are a term by themselves."""
    words = {w for term in t.ARABIC_TERMS for w in term.split() if len(w) >= 3}
    return {w: t.ARABIC_TERMS.get(w) for w in sorted(words)}


def budget(length: Column) -> Column:
    """Edits that a word of this length is allowed."""
    return F.when(length <= 3, 0).when(length <= 5, 1).otherwise(2)


def _shorter(word: Column) -> Column:
    """The word with one letter left out, for each of its letters."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))


def shortened(word: Column, most: Column) -> Column:
    """The word (of three letters or more) and what is left of it without up to ``most`` letters, two at most.
    Words within so many edits of one another have a common one, as each edit is a letter less on one side
    or on both."""
    one = _shorter(word)
    two = F.when(most >= 2, F.flatten(F.transform(one, _shorter))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), one, two))


def nearby(own: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of a row of ``own`` (``word, stem, arabic, allowed``) and of ``known`` (``known, meaning, arabic``)
    whose words may be within ``allowed`` edits: an equi-join on shortened words."""
    index = known.select("*", F.explode(shortened(F.col("known"), F.lit(2))).alias("key"))
    looked = own.select("*", F.explode(shortened(F.col("stem"), F.col("allowed"))).alias("key"))
    hits = looked.join(F.broadcast(index), ["arabic", "key"])  # the vocabulary is fixed and small, and so are its shortened words
    return hits.drop("key").dropDuplicates(["word", "known"])


def corrections(words: DataFrame) -> DataFrame:
    """``word, fixed`` for each word (column ``word``, small letters) that has a correction: the
    one nearest vocabulary word within the budget.  Several nearest Arabic words are no tie if
    all mean the same; the first in order is taken."""
    spark = words.sparkSession
    known = spark.createDataFrame([(w, w, False) for w in vocabulary()] + [(w, m, True) for w, m in arabic_vocabulary().items()], "known string, meaning string, arabic boolean")
    own = words.select("word").distinct().withColumn("arabic", has_arabic(F.col("word")))
    own = own.withColumn("folded", F.when(F.col("arabic"), fold(F.col("word"))).otherwise(F.col("word")))
    article = F.col("arabic") & F.startswith("folded", F.lit(t.ARTICLE)) & (F.length("folded") > len(t.ARTICLE) + 2)
    bare = F.expr(f"substring(folded, {len(t.ARTICLE) + 1})")
    own = own.withColumn("stem", F.when(article, bare).otherwise(F.col("folded"))).withColumn("prefix", F.when(article, t.ARTICLE).otherwise(""))
    right = F.when(F.col("arabic"), F.col("folded").isin(*arabic_vocabulary()) | (F.startswith("folded", F.lit(t.ARTICLE)) & bare.isin(*arabic_vocabulary()))).otherwise(F.col("folded").isin(*vocabulary()))
    own = own.filter(~right & ~F.col("word").rlike(r"(?U)\d")).withColumn("allowed", budget(F.length("stem"))).filter("allowed > 0")
    longest = max(map(len, [*vocabulary(), *arabic_vocabulary()]))
    near = nearby(own.filter(F.length("stem") <= longest + F.col("allowed")), known)  # longer ones are near to none
    near = near.withColumn("edits", F.levenshtein("stem", "known")).filter(F.col("edits") <= F.col("allowed"))
    near = near.withColumn("least", F.min("edits").over(W.partitionBy("word"))).filter("edits = least")
    best = near.groupBy("word", "arabic", "prefix").agg(F.count("*").alias("n"), F.countDistinct("meaning").alias("meanings"), F.count_if(F.col("meaning").isNull()).alias("unclear"), F.min("known").alias("known"))
    clear = (F.col("n") == 1) | (F.col("arabic") & (F.col("meanings") == 1) & (F.col("unclear") == 0))
    return best.filter(clear).select("word", F.concat("prefix", "known").alias("fixed"))


def correct(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, corrected, corrections``: each run of letters replaced by its correction."""
    runs = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)).alias("runs"), F.split(F.col(text_col), WORD, -1).alias("gaps"))
    typed = runs.select("id", F.posexplode("runs").alias("at", "typed")).withColumn("word", F.lower("typed"))
    fixed = typed.join(corrections(typed), "word", "left")
    each = fixed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "typed", "fixed"))).alias("each"))
    whole = runs.join(each, "id", "left")
    pieces = F.zip_with("gaps", F.transform("each", lambda x: F.coalesce(x["fixed"], x["typed"])), lambda g, w: F.concat(g, F.coalesce(w, F.lit(""))))
    changed = F.filter("each", lambda x: x["fixed"].isNotNull())
    return whole.select("id", "text", F.coalesce(F.array_join(pieces, ""), F.col("text")).alias("corrected"),
                        F.coalesce(F.map_from_entries(F.array_distinct(F.transform(changed, lambda x: F.struct(x["typed"], x["fixed"])))), F.create_map().cast("map<string,string>")).alias("corrections"))


def accepted(parsed: Column, parsed_corrected: Column) -> Column:
    """A correction stands only if it makes the query specify more."""
    return F.size(parsed_corrected["attributes"]) > F.size(parsed["attributes"])
