"""Names that contain a term, by an inverted index of letter runs.

A name is listed under every run of ``SIZE`` of its letters, case folded, and under shorter runs only
where a term is that short.  A term looks up the rarest of its own runs; names listed under all of
them are few, and are tested for the term itself.  So terms meet names by equi-joins on runs, and a
run that most names share is looked up only by a term that has no rarer one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.session import settled

#: Letters of a run; how many of its runs, the rarest ones, a term looks up.
SIZE, RAREST = 3, 2


def runs(text: Column, size: int = SIZE) -> Column:
    """Distinct runs of ``size`` characters of a text; none of a shorter one."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1)))
    return F.coalesce(F.array_distinct(F.transform(places, lambda at: F.substr(text, at, F.lit(size)))), F.array().cast("array<string>"))


def name_index(names: DataFrame, sizes: tuple[int, ...] = (1, 2, SIZE)) -> DataFrame:
    """``run, folded``: each distinct folded name (column ``name``) under its runs of these sizes."""
    folded = names.filter("name is not null").select(F.lower("name").alias("folded")).distinct()
    return reduce(DataFrame.unionByName, [folded.select(F.explode(runs(F.col("folded"), n)).alias("run"), "folded") for n in sizes])


def containing(terms: DataFrame, names: DataFrame, rarest: int = RAREST) -> DataFrame:
    """``term, folded``: each term (column ``term``, not empty) with the folded names that contain it, case
    folded.  No character of a term is a wildcard; a null or empty term is in no name."""
    asked = terms.filter("term is not null and term <> ''").select("term", F.lower("term").alias("wanted")).distinct()
    wanted = asked.select("term", "wanted", F.explode(F.when(F.length("wanted") < SIZE, F.array("wanted")).otherwise(runs(F.col("wanted")))).alias("run"))
    wanted = settled(wanted)
    sizes = tuple(sorted(r[0] for r in wanted.select(F.least(F.length("run"), F.lit(SIZE))).distinct().collect()))  # at most SIZE numbers
    if not sizes:
        return terms.limit(0).select("term", F.lit("").alias("folded"))
    index = settled(name_index(names, sizes).join(wanted.select("run").distinct(), "run", "left_semi"))
    listed = wanted.join(index.groupBy("run").agg(F.count("*").alias("names")), "run", "left").withColumn("names", F.coalesce("names", F.lit(0)))
    nth = F.row_number().over(W.partitionBy("term").orderBy("names", "run"))
    chosen = listed.withColumn("nth", nth).filter(F.col("nth") <= rarest).select("term", "wanted", "run")
    looked_up = chosen.join(index, "run").groupBy("term", "wanted", "folded").agg(F.count("*").alias("runs"))
    needed = chosen.groupBy(F.col("term").alias("of_term")).agg(F.count("*").alias("needed"))
    found = looked_up.join(needed, (F.col("term") == F.col("of_term")) & (F.col("runs") == F.col("needed")))
    return found.filter(F.contains("folded", F.col("wanted"))).select("term", "folded")
