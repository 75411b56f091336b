"""Report sinks: JSON lines, and site maps with their index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SITEMAP, HEAD = "http://www.sitemaps.org/schemas/sitemap/0.9", '<?xml version="1.0" encoding="UTF-8"?>\n'
#: Addresses of a site map, and site maps of an index, by the protocol.
MOST = 50_000


def write_json(report: DataFrame, path: str) -> None:
    """One JSON object a row, written by the tasks."""
    report.write.mode("overwrite").json(path)


def sitemap_documents(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``doc``: site maps of at most ``most`` addresses each, from rows with ``xml`` and a unique ``key``, in order
    of the key.  Places are counted within ranges of the key, so no task orders all of them."""
    ranged = rows.repartitionByRange(key).select(F.spark_partition_id().alias("range"), F.col(key).alias("key"), "xml")
    place = F.row_number().over(W.partitionBy("range").orderBy("key")) - 1
    cut = ranged.withColumn("map", F.floor(place / most))
    return cut.groupBy("range", "map").agg(F.array_sort(F.collect_list(F.struct("key", "xml"))).alias("held")).select(
        F.concat(F.lit(f'{HEAD}<urlset xmlns="{SITEMAP}">\n'), F.array_join("held.xml", "\n"), F.lit("\n</urlset>")).alias("doc"))


def write_sitemaps(rows: DataFrame, key: str, path: str, base_url: str, most: int = MOST) -> list[str]:
    """Site maps in ``path/maps``, one document a file, and then in ``path/index`` what names them at ``base_url``.
    Spark's commit leaves no file of a task that failed, and the index is of the files that were committed; it is
    written last.  Gives the names."""
    session = rows.sparkSession
    sitemap_documents(rows, key, most).write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{path}/maps")
    files = session.read.format("binaryFile").load(f"{path}/maps").filter("length > 0").select(F.element_at(F.split("path", "/"), -1))  # none is read
    names = sorted(r[0] for r in files.collect())  # one in 50,000 addresses
    head, tail = f'{HEAD}<sitemapindex xmlns="{SITEMAP}">\n', "\n</sitemapindex>"
    index = [head + "\n".join(f"<sitemap><loc>{base_url}/{n}</loc></sitemap>" for n in names[k:k + MOST]) + tail for k in range(0, max(len(names), 1), MOST)]
    session.createDataFrame([(x,) for x in index], "doc string").coalesce(1).write.mode("overwrite").option("maxRecordsPerFile", 1).text(f"{path}/index")
    return names


def read_sitemaps(session: SparkSession, path: str) -> DataFrame:
    """``file, loc, lastmod`` of the addresses in the written site maps."""
    lines = session.read.text(f"{path}/maps").select(F.col("_metadata.file_name").alias("file"), "value").filter(F.startswith("value", F.lit("<url>")))
    part = lambda tag: F.regexp_extract("value", f"<{tag}>(.*)</{tag}>", 1)
    return lines.select("file", part("loc").alias("loc"), part("lastmod").alias("lastmod"))


def replay_lines(answers: DataFrame) -> DataFrame:
    """Landed answers as JSON lines (column value), for gzip text files."""
    return answers.select(F.to_json(F.struct(*answers.columns)).alias("value"))
