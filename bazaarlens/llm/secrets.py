"""Secret scans with corpus-wide ownership frequency [native].

Base patterns find keyword assignments, access keys and long hex runs; a looser pattern finds
other key-shaped tokens.  Every candidate value is hashed and counted over the corpus by
distinct owners and repositories: a value in ``copied_by`` repositories or more, of two owners at
least, is a copied example; any other that looks random is a live-looking credential, be it in
many repositories of its one owner.  Loose tokens become spans only if the counts say so; base
spans always stay.

The counts combine before they are shuffled.  Values that a task's share of all candidates or more
carry are few by that measure, so their counts are broadcast; the others' are joined by hash.  All
spans of one text are gathered in one row, as the text itself is.

Defined results: a null text is empty and has no spans; null owners or repositories count as
one owner or repository of their own; repeated rows are scanned each for itself and count once
as owner; an empty table gives an empty result; columns of the input that clash with result
names are not read (only the named ones are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.scratch import Scratch, fresh

#: Kind, pattern, the group that holds the value, least length of that value.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # a run from its first AKIA; shorter ones fail whole
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
LOOSE = ("owned", r"[A-Za-z0-9+/_-]{24,}", 0, 24)
#: Bytes of spans that may be broadcast; spans of one value that a task takes in any case.
BROADCAST, COMMON = 32 << 20, 10_000
#: A value with one of these is a placeholder, whoever carries it.
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|your|placeholder|xxxx|0000|1234567|abcdef"
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string>"


def find_spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches with code-point offsets: the pieces between matches
    and the matches themselves, laid end to end."""
    hits, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(done: Column, part: Column) -> Column:
        start = done["at"] + F.length(part["gap"])
        end = start + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), part["value"].alias("value"))
        keep = F.coalesce(F.length(part["value"]) >= least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.array_append(done["spans"], span.cast(SPAN))).otherwise(done["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda x: x["spans"])).otherwise(none)


def live_looking(value: Column) -> Column:
    """Letters and digits, varied, and no word that marks a placeholder."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER) & varied


def loose_tokens(text: Column) -> Column:
    """Key-shaped tokens: long, with capitals, small letters and digits."""
    found = find_spans(text, len(KINDS), *LOOSE)
    return F.filter(found, lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Z]") & s["value"].rlike("[a-z]"))


def render(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None,
         keep: tuple[str, ...] = (), copied_by: int = 3, row_col: str | None = None) -> DataFrame:
    """One row per document: ``row`` (its key in this run, or ``row_col``), id, ``keep`` columns,
    ``base`` spans, all ``spans`` with ``owners``, ``repositories`` and ``verdict`` ("example",
    "live" or "plain", as above)."""
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    owner = F.col("source") if owner is None else owner
    repository = F.col(id_col) if repository is None else repository
    found = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("id"), *[F.col(c).alias(f"k_{c}") for c in keep], owner.cast("string").alias("owner"), repository.cast("string").alias("repository"),
        F.array_sort(F.concat(*[find_spans(text, i, *kind) for i, kind in enumerate(KINDS)])).alias("base"), loose_tokens(text).alias("loose"),
    )
    found = scratch.table(found, "found")
    # A loose token inside a base span is that span's own value.
    free = F.filter("loose", lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    candidates = found.select("row", "owner", "repository", F.explode(F.concat("base", free)).alias("span")).withColumn("hash", F.sha2("span.value", 256))
    # One row per hash, owner and repository before the counts: a hash that everyone carries arrives combined.
    per_owner = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("carried"))
    ownership = scratch.table(per_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.sum("carried").alias("carried")), "ownership")
    shares = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = ownership.agg(F.coalesce(F.sum("carried"), F.lit(0))).first()[0]
    common = F.col("carried") > max(COMMON, whole // shares)  # fewer hashes than tasks
    counts = candidates.join(F.broadcast(ownership.filter(common).drop("carried")), "hash", "left")
    rest = counts.filter("owners is null").drop("owners", "repositories").join(ownership.filter(~common).drop("carried"), "hash")
    judged = counts.filter("owners is not null").unionByName(rest).withColumn(
        "verdict", F.when((F.col("repositories") >= copied_by) & (F.col("owners") > 1), "example").when(live_looking(F.col("span.value")), "live").otherwise("plain"))
    judged = judged.filter((F.col("span.rank") < len(KINDS)) | (F.col("verdict") == "live"))
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("span.*", "owners", "repositories", "verdict"))).alias("spans"))
    return found.drop("loose", "owner", "repository").join(per_row, "row", "left")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and span strings of ``scan``'s rows."""
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,owners:bigint,repositories:bigint,verdict:string>>"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    verdict = lambda name: F.size(F.filter(spans, lambda s: s["verdict"] == name)).cast("long")
    return scanned.select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{k}") for k, *_ in KINDS], F.sha2(render(F.col("base")), 256).alias("base_sha256"),
        render(spans).alias("spans"), verdict("live").alias("n_live"), verdict("example").alias("n_example"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["repositories"])), F.lit(0)).alias("most_repositories"),
    )


def masked(text: Column, spans: Column, label: str = "[secret]") -> Column:
    """``text`` with the given spans replaced; where spans overlap, the first to start stands for all."""
    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        fresh = s["start"] >= done["at"]
        out = F.when(fresh, F.concat(done["out"], gap, F.lit(label))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(spans, start, step, lambda x: F.concat(x["out"], F.substring(text, x["at"] + 1, F.length(text))))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **options: object) -> DataFrame:
    """All documents, live-looking credentials masked in the text; ``length_col``, if given, is
    set to the new length of the texts that changed."""
    scratch, row = Scratch(docs.sparkSession, "redact"), fresh(docs, "__row")
    numbered = scratch.numbered(docs, row)
    live = F.filter("spans", lambda s: s["verdict"] == "live")
    spans = scan(numbered, text_col=text_col, row_col=row, **options).select(F.col("row").alias(row), live.alias("__live")).filter(F.size("__live") > 0)
    spans = scratch.table(spans, "spans")
    size = spans.agg(F.coalesce(F.sum(F.size("__live") * 200 + 24), F.lit(0))).first()[0]
    marked = numbered.join(F.broadcast(spans) if size <= BROADCAST else spans, row, "left")  # few texts have spans, and the others need not move
    found = marked["__live"]
    text = F.when(found.isNotNull(), masked(numbered[text_col], found)).otherwise(numbered[text_col])
    value = {c: numbered[c] for c in docs.columns} | {text_col: text}
    if length_col:
        value[length_col] = F.when(found.isNotNull(), F.length(text).cast(docs.schema[length_col].dataType)).otherwise(numbered[length_col])
    return marked.select(*[value[c].alias(c) for c in docs.columns])
