"""Mixing sources to target weights by a low-discrepancy schedule [native].

The mix is a sequence of slots of equal token counts, and documents come in its order.  Slot j looks up the golden-ratio point
frac((j + 1/2) * phi) in the cumulative weights and so names its source; a source's slots are
ranked, and the slot of rank r reads block r of the source's documents, shuffled by hash, laid
end to end and cut into equal-token blocks; after the last block the source starts again.  The
sequence has slots for the total and a little more; a source whose share the points missed there
(its target may be far under a block) gets the ranks up to its target all the same, in slots at the
end.  So ``slot`` says where in the mix a document is read: any run of the sequence, from its start or
not, holds the sources by their weights up to a few slots, and a training run that stops early has seen
them so.

Targets: sources in code-point order, nulls last, share all words by weights 1, 2, 3 repeating,
none above ``most`` times its own words; what is cut off is shared again by weight.

Defined results: a null or empty text has no words and is taken 0 words; a null source is a
source; rows that share an id are shuffled by size too, so reruns agree; an empty table gives
an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bazaarlens.llm.scratch import Scratch, fresh

WORD = r"[^\x20\x09-\x0D]+"
PHI = 0.6180339887498949  # fractional part of the golden ratio
#: Slots that one window task ranks, and hash ranges into which a source's documents are dealt.
RUN, RANGES = 1 << 16, 4096
#: Bytes of what is taken that may be broadcast.
BROADCAST = 32 << 20


def words(text: Column) -> Column:
    """Words of a text: the places where one starts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``: one row a source.

    Sources sorted by cap over weight fill up in that order; the first k are capped where the
    level (total - their caps) / (other weights) still reaches the k-th one's cap over weight.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    level = W.orderBy("ratio", "nr").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("nr") % len(weights) + 1).cast("int"))
    out = sizes.withColumn("nr", F.row_number().over(order) - 1).withColumn("weight", w.cast("long"))
    out = out.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    total, rest = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    before = lambda c: F.coalesce(F.sum(c).over(level), F.lit(0))
    out = out.withColumn("level", (total - before("cap")).cast("double") / (rest - before("weight")))
    out = out.withColumn("capped", F.col("ratio") <= F.col("level"))
    free = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)  # the first one's: levels fall from there on
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * free)
    return out.select("source", "source_size", "weight", "nr", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int | None = None,
        most: int = 3, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", keep: tuple[str, ...] = (), row_col: str | None = None) -> DataFrame:
    """One row per document: row (``row_col``, or a number of this run), id, ``keep`` columns as ``k_<name>``, size, source_size, target,
    ``start`` (its place in the source's stream), ``taken`` words and ``takes``: for each round of
    the stream that reaches it, in order, the first slot that reads it and how many words of it are read.
    ``block``: words in a slot; by default the 2**18th part of all words, 64 at least."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("id"), *[F.col(c).alias(f"k_{c}") for c in keep],
                        F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), digest.alias("digest"))
    sized = scratch.table(sized.withColumn("range", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")), "sized")

    # A source's documents in hash order: ranges of the hash are summed first, so that no task orders a whole source.
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    ranges = scratch.table(ranges.withColumn("range_start", F.sum("range_size").over(W.partitionBy("source").orderBy("range")) - F.col("range_size")), "ranges")
    goal = scratch.table(targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), most, weights), "goal")
    total, shared, sources = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    block = block or max(64, total // (1 << 18))
    inner = W.partitionBy("source", "range").orderBy("digest", "size", "id")
    where = ranges.select(F.col("source").alias("r_source"), F.col("range").alias("r_range"), "range_start")
    placed = sized.join(where, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    placed = placed.withColumn("start", F.col("range_start") + F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = scratch.table(placed.select("row", "id", *[f"k_{c}" for c in keep], "source", "size", "start"), "placed")

    ranked, share = schedule(spark, goal, scratch, block, shared, sources)
    # The rank-r slot reads words [r * block, (r + 1) * block) of the source's endless stream, up to the target; folded
    # into the source's one round of documents, these are parts of one or more of its blocks.
    reads = ranked.join(share.select("nr", "source", "source_size", "goal"), "nr").filter((F.col("rank") * block < F.col("goal")) & (F.col("source_size") > 0))
    reads = reads.select("source", "source_size", "slot", (F.col("rank") * block).alias("a"), F.least((F.col("rank") + 1) * block, F.col("goal")).alias("b"))
    size = F.col("source_size")
    reads = reads.withColumn("round", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size))))
    reads = reads.select("source", "slot", "round", (F.greatest("a", F.col("round") * size) - F.col("round") * size).alias("a"), (F.least("b", (F.col("round") + 1) * size) - F.col("round") * size).alias("b"))
    reads = reads.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    lo, hi = F.greatest("a", F.col("block") * block), F.least("b", (F.col("block") + 1) * block)
    reads = reads.select("source", "block", "slot", "round", lo.alias("a"), hi.alias("b"))

    parts = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    reads = reads.withColumnsRenamed({"source": "r_source", "block": "r_block"})
    met = parts.select("row", "source", "start", "size", "block").join(reads, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("block") == F.col("r_block")))
    lo = F.greatest("a", "start", F.col("block") * block)
    overlap = F.greatest(F.least("b", F.col("start") + F.col("size")) - lo, F.lit(0))
    met = met.withColumn("words", overlap).filter("words > 0").groupBy("row", "round").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))
    taken = met.groupBy("row").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("round", "slot", "words"))).alias("takes"))  # ``most`` rounds at most
    facts = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    out = placed.join(taken, "row", "left").join(F.broadcast(facts) if sources <= 10_000 else facts, F.col("source").eqNullSafe(F.col("g_source")))
    return out.select("row", "id", *[f"k_{c}" for c in keep], "source", "size", "start", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce(F.transform("takes", lambda t: F.struct(t["slot"], t["words"])), F.array().cast("array<struct<slot:bigint,words:bigint>>")).alias("takes"))


def schedule(spark: SparkSession, goal: DataFrame, scratch: Scratch, block: int, shared: float, sources: int) -> tuple[DataFrame, DataFrame]:
    """``nr, slot, rank``: the source of each slot of the mix and which of its slots that is, from ``goal``
    (``targets`` of all ``sources``, whose sum is ``shared``); and each source's share of the line 0..1."""
    share = goal.select("source", "nr", "source_size", F.floor("target").alias("goal"), (F.sum("target").over(W.orderBy("nr")) / F.lit(shared or 1.0)).alias("upto"))
    share = share.withColumn("from", F.coalesce(F.lag("upto").over(W.orderBy("nr")), F.lit(0.0)))
    slots = int(shared * 1.001) // block + 64 * sources  # beyond the total, as points fall a few short of a share
    slot = spark.range(slots).select(F.col("id").alias("slot"), _point(F.col("id")).alias("point"))
    # Sources are few against slots, but their number is not bounded: an interval is found through the grid cell of its point.
    cells = 4096
    grid = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * cells), F.least(F.floor(F.col("upto") * cells), F.lit(cells - 1)))))
    named = slot.withColumn("cell", F.floor(F.col("point") * cells)).join(grid, "cell").filter((F.col("point") >= F.col("from")) & (F.col("point") < F.col("upto")))
    named = named.select("nr", "slot", F.floor(F.col("slot") / RUN).alias("run"))
    runs = named.groupBy("nr", "run").agg(F.count("*").alias("n"))
    runs = scratch.table(runs.select("nr", "run", "n", (F.sum("n").over(W.partitionBy("nr").orderBy("run")) - F.col("n")).alias("ranked")), "runs")
    ranked = named.join(runs.drop("n"), ["nr", "run"]).select("nr", "slot", (F.col("ranked") + F.row_number().over(W.partitionBy("nr", "run").orderBy("slot")) - 1).alias("rank"))
    # Points are even up to a few slots a source: the few ranks that a source still misses follow as later slots would bring them.
    got = runs.groupBy("nr").agg(F.sum("n").alias("got"))
    due = share.select("nr", F.ceil(F.col("goal") / block).alias("due")).join(got, "nr", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    late = due.filter("got < due").select("nr", F.explode(F.sequence(F.col("got"), F.col("due") - 1)).alias("rank"))
    return ranked.unionByName(late.select("nr", (slots + F.col("rank") * sources + F.col("nr")).alias("slot"), "rank")), share


def _point(j: Column) -> Column:
    """frac((j + 1/2) * phi), its high and low digits apart to keep the precision."""
    high, low = F.floor(j / (1 << 20)), j % (1 << 20)
    x = (high * F.lit(PHI * (1 << 20) % 1.0)) % 1.0 + (low * F.lit(PHI)) % 1.0 + F.lit(PHI / 2)
    return x % 1.0


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select(F.col("id").alias("doc_id"), F.col("size"), F.col("source_size"), F.col("target"), F.col("taken"), F.array_min(F.transform("takes", lambda t: t["slot"])).alias("first_slot"), F.size("takes").alias("n_takes"))


def mixed_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **options: object) -> DataFrame:
    """The mix as documents, in the order of its slots over all partitions: each as often as it is taken
    whole, and once more with its first words where the target ends inside it.  A document of no words
    is not part of a mix."""
    scratch, row = Scratch(docs.sparkSession, "mixed"), fresh(docs, "__row")
    numbered = scratch.numbered(docs, row)
    mixed = mix(numbered, text_col=text_col, row_col=row, **options).filter("taken > 0")
    copies = F.transform("takes", lambda t: F.struct(t["slot"].alias("slot"), F.when(t["words"] < F.col("size"), t["words"].cast("int")).alias("first")))
    takes, take = scratch.table(mixed.select(F.col("row").alias(row), copies.alias("__takes")), "takes"), fresh(docs, "__take")
    small = takes.agg(F.coalesce(F.sum(F.size("__takes") * 16 + 24), F.lit(0))).first()[0] <= BROADCAST
    joined = numbered.join(F.broadcast(takes) if small else takes, row)
    out = joined.select(*[numbered[c] for c in docs.columns], numbered[row], F.explode(takes["__takes"]).alias(take))
    order, first = [F.col(take)["slot"], F.col(row)], F.col(take)["first"]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    text, cut = F.col(text_col), first.isNotNull()
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), first), "")
    value = {c: F.col(c) for c in docs.columns} | {text_col: F.when(cut, part).otherwise(text)}
    if length_col:
        value[length_col] = F.when(cut, F.length(part).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col))
    return out.select(*[value[c].alias(c) for c in docs.columns])
