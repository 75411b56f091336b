"""Size-tiered shards with an atomically committed manifest.

Arrivals are appended as small immutable Parquet files.  Compaction groups files of similar
size (one tier: sizes within a factor) and merges runs of them into files of about the target
size, a run a task.  What is live is what the newest manifest names: a manifest is a folder of
file rows.

A commit reads the newest manifest, writes its successor beside it and renames that to the very
next version number, which fails if another writer has taken it; then all is read anew and tried
again.  So no commit is lost, and none undone.  A compaction whose inputs another one has taken
meanwhile gives up its output and plans again.  Readers of an older version are not disturbed until
``vacuum`` drops it, as files are never changed.  ``vacuum`` deletes files that only dropped versions name, and what failed
commits have left, once that is older than a period of grace (a running commit's files are young).

The driver holds names of live files, as any scan of them does, and at most ``ROUND`` files of a
compaction round; what else grows with the files is joined.

Defined results: nulls, empty and very long texts and repeated rows pass through unchanged; an
empty arrival adds no file; reading a store without files gives no rows; all columns of an
arrival are kept, whatever their names.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

#: Rows of a small shard, bytes of a merged one, sizes of a tier; files merged in a round; tries of a commit; seconds of grace.
SMALL_ROWS, TARGET, FACTOR, ROUND, TRIES, GRACE = 4096, 64 << 20, 4, 50_000, 50, 86_400
FILES = "path string, bytes long"


class InputsGone(Exception):
    """Another compaction has replaced the files that this one has merged."""


class ShardStore:
    """A versioned set of immutable shards of rows of one schema, under a shared folder."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType) -> None:
        self.spark, self.root, self.schema = spark, root, schema
        self._jvm = spark._jvm
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._path(f"{self.root}/manifest")
        if not self._fs().exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())

    def newest(self) -> int:
        return (self.versions() or [0])[-1]

    def files(self, version: int | None = None) -> DataFrame:
        """path and bytes of each live shard of a version, by default the newest."""
        version = self.newest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(self._manifest(version))

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of all live shards."""
        paths = [r["path"] for r in self.files(version).select("path").collect()]  # names of files, not rows
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, small_rows: int = SMALL_ROWS) -> int:
        """Add an arrival as new small shards and commit; gives the version."""
        return self._commit(self._written(rows, small_rows)[1], None)

    def compact(self, target: int = TARGET, factor: int = FACTOR) -> int:
        """Merge until no tier holds a run of two or more files; gives the version."""
        while version := self.newest():
            plan = self._plan(self.files(version), target, factor).collect()  # ROUND files at most
            if not plan:
                return version
            # A join on the file's path gives each row its run, and each run is one task and one file.
            runs = self.spark.createDataFrame([(r["path"], r["run"]) for r in plan], "__shard_path string, __shard_run int")
            rows = self.spark.read.schema(self.schema).parquet(*[r["path"] for r in plan]).select("*", F.col("_metadata.file_path").alias("__shard_path"))
            rows = rows.join(F.broadcast(runs), "__shard_path").repartitionById(max(r["run"] for r in plan) + 1, F.col("__shard_run"))
            folder, new = self._written(rows.drop("__shard_path", "__shard_run"), None)
            try:
                self._commit(new, runs.select(F.col("__shard_path").alias("path")))
            except InputsGone:
                self._fs().delete(self._path(folder), True)
        return 0

    def pending(self, target: int = TARGET, factor: int = FACTOR) -> DataFrame:
        """path and run of the live shards that a compaction would merge now."""
        return self._plan(self.files(), target, factor)

    def vacuum(self, keep: int = 1, grace: float = GRACE) -> None:
        """Keep the newest ``keep`` versions and the files they name.  Files of older versions go
        at once; files and drafts of no version go after ``grace`` seconds."""
        have = self.versions()
        kept, dropped = have[-keep:], have[:-keep]
        named = lambda versions: self.spark.read.schema(FILES).parquet(*map(self._manifest, versions)).select("path").distinct() if versions else self.files(0).select("path")
        if not self._fs().exists(self._path(f"{self.root}/data")):
            return
        found = self._listed(f"{self.root}/data")
        old = F.col("modificationTime") < F.lit(time.time() - grace).cast("timestamp")
        doomed = found.join(named(kept), "path", "left_anti").join(named(dropped).withColumn("named", F.lit(True)), "path", "left").filter(F.col("named") | old)
        for r in doomed.select("path").toLocalIterator():
            self._fs().delete(self._path(r["path"]), False)
        drafts = [s.getPath() for s in self._fs().listStatus(self._path(f"{self.root}/manifest")) if s.getPath().getName().startswith("draft-") and s.getModificationTime() < (time.time() - grace) * 1000]
        for path in [*drafts, *[self._path(self._manifest(v)) for v in dropped]]:
            self._fs().delete(path, True)

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifest/v{version:012d}"

    def _listed(self, folder: str) -> DataFrame:
        return self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder).drop("content")

    def _plan(self, files: DataFrame, target: int, factor: int) -> DataFrame:
        """path and run of the files to merge: in each tier, in order, sums cut at the target; runs
        count from 0, and the first that come to ROUND files (one run at least) make a round."""
        tier = F.floor(F.log(F.greatest(F.col("bytes"), F.lit(1))) / F.log(F.lit(float(factor))))
        small = files.filter(F.col("bytes") < target // 2).withColumn("tier", tier)
        upto = F.sum("bytes").over(W.partitionBy("tier").orderBy("path"))
        parts = small.withColumn("part", F.floor((upto - F.col("bytes")) / target)).withColumn("nth", F.row_number().over(W.partitionBy("tier", "part").orderBy("path")))
        parts = parts.filter(F.col("nth") <= ROUND)
        runs = parts.groupBy("tier", "part").agg(F.count("*").alias("n")).filter("n > 1")
        order = W.orderBy("tier", "part")
        runs = runs.withColumn("run", F.row_number().over(order) - 1).withColumn("before", F.sum("n").over(order) - F.col("n")).filter((F.col("run") == 0) | (F.col("before") + F.col("n") <= ROUND))
        return parts.join(runs, ["tier", "part"]).select("path", "run")

    def _written(self, rows: DataFrame, most_rows: int | None) -> tuple[str, DataFrame]:
        """Write rows to a new folder; it, and path and bytes of its files."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", most_rows) if most_rows else writer).parquet(folder)
        return folder, self._listed(folder).select("path", F.col("length").alias("bytes"))

    def _commit(self, new: DataFrame, gone: DataFrame | None) -> int:
        """Publish the newest version's files and ``new`` ones, without the ``gone``, as the next."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        for _ in range(TRIES):
            version = self.newest()
            files = self.files(version)
            if gone is not None:
                if gone.join(files, "path", "left_anti").count():
                    raise InputsGone
                files = files.join(gone, "path", "left_anti")
            draft, final = f"{self.root}/manifest/draft-{uuid.uuid4().hex}", self._manifest(version + 1)
            files.unionByName(new).coalesce(1).write.parquet(draft)
            try:
                context.rename(self._path(draft), self._path(final), never_over)
                return version + 1
            except Py4JJavaError:
                if not self._fs().exists(self._path(final)):
                    raise
                self._fs().delete(self._path(draft), True)  # another writer was faster
        raise RuntimeError(f"no commit in {TRIES} tries")
