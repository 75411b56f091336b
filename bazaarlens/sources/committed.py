"""Catalogue tables that ingest runs are committed to, and their history.

A run is committed in two steps.  Its outcome (the rows of each table that it changed, and the history
rows) is written to a folder of the run's own and sealed by an empty file, made at once; then the
outcome is put into the tables: only the partitions that hold changed rows are replaced, each by its
rows without the changed keys and the changed rows.  Putting an outcome in twice gives the same tables.

So a run that is repeated after a failure is computed again only if its outcome was not sealed, when
the tables are still as they were; else its outcome is put in again.  The history is that of sealed
runs, a partition a run, so a repeat appends nothing.  One run at a time: the next one starts only
when the last is put in, which ``commit`` does first.

Rows are dealt to ``parts`` partitions by a hash of their key, so a run of few shops over a large
catalogue still touches most partitions of it once its listings outnumber them: choose ``parts`` so
that a partition is a few files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.operators.ingest import Run

#: The tables and the key of each.
KEYS = {"products": "id", "aliases": "alias_id", "prices": "alias_id"}
SEALED, APPLIED = "_SEALED", "_APPLIED"


class CommittedCatalogue:
    """Tables ``products``, ``aliases`` and ``prices``, and ``history``, under a shared folder."""

    def __init__(self, spark: SparkSession, root: str, parts: int = 64) -> None:
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def start(self, **tables: DataFrame) -> None:
        """Write the tables as they are before any run."""
        for name in KEYS:
            self._dealt(tables[name], name).write.partitionBy("part").parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        """A table as the last applied run has left it."""
        return self.spark.read.parquet(f"{self.root}/{name}").drop("part")

    def history(self) -> DataFrame:
        """History rows of all sealed runs, with their ``run_id``."""
        runs = [r for r in self._runs() if self._has(r, SEALED)]
        schema = "alias_id long, price decimal(18,3), recorded_at timestamp, run_id string"
        parts = [f"{self.root}/runs/run_id={r}/history" for r in runs]
        if not parts:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.option("basePath", f"{self.root}/runs").parquet(*parts)
        return found.withColumn("run_id", F.col("run_id").cast("string"))

    def commit(self, run_id: str, make: Callable[[], Run]) -> bool:
        """Commit the run that ``make`` computes from the tables; false if it was committed before.
        Runs that were sealed but not put in are put in first."""
        for earlier in self._runs():
            if earlier != run_id and self._has(earlier, SEALED) and not self._has(earlier, APPLIED):
                self._apply(earlier)
        if self._has(run_id, APPLIED):
            return False
        if not self._has(run_id, SEALED):
            self._write(run_id, make())
            self._mark(run_id, SEALED)
        self._apply(run_id)
        return True

    def _write(self, run_id: str, run: Run) -> None:
        """The outcome of a run: what it changed in each table and what it added, and its history."""
        for name, key in KEYS.items():
            before, kept, added = self.read(name), run.kept[name], run.added[name]
            columns = before.columns
            for c in columns:  # a run tells of what it knows; the rest of a row stays
                kept = kept if c in kept.columns else kept.join(before.select(key, c), key, "left")
                added = added if c in added.columns else added.withColumn(c, F.lit(None).cast(before.schema[c].dataType))
            same = [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) if not _mapped(before, c) else F.to_json(F.struct(f"b.{c}")).eqNullSafe(F.to_json(F.struct(f"a.{c}"))) for c in columns if c != key]
            unchanged = F.col(f"a.{key}") == F.col(f"b.{key}")
            for s in same:
                unchanged = unchanged & s
            changed = kept.select(*columns).alias("a").join(before.alias("b"), unchanged, "left_anti")
            self._dealt(changed.unionByName(added.select(*columns)), name).write.mode("overwrite").parquet(self._of(run_id, name))  # what is new meets nothing
        run.history.write.mode("overwrite").parquet(self._of(run_id, "history"))

    def _apply(self, run_id: str) -> None:
        for name, key in KEYS.items():
            changed = self.spark.read.parquet(self._of(run_id, name))
            table = self.spark.read.parquet(f"{self.root}/{name}")
            touched = [r[0] for r in changed.select("part").distinct().collect()]  # ``parts`` numbers at most
            kept = table.filter(F.col("part").isin(touched)).join(changed.select(key), key, "left_anti")
            whole = kept.repartition("part").unionByName(changed)  # changed rows are written by whoever reads them, however many go to a partition
            if touched:
                whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{self.root}/{name}")
        self._mark(run_id, APPLIED)

    def _dealt(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(F.col(KEYS[name]).cast("long")), F.lit(self.parts)).cast("int"))

    def _of(self, run_id: str, name: str) -> str:
        return f"{self.root}/runs/run_id={run_id}/{name}"

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _has(self, run_id: str, mark: str) -> bool:
        return self._fs.exists(self._path(self._of(run_id, mark)))

    def _mark(self, run_id: str, mark: str) -> None:
        self._fs.createNewFile(self._path(self._of(run_id, mark)))

    def _runs(self) -> list[str]:
        folder = self._path(f"{self.root}/runs")
        if not self._fs.exists(folder):
            return []
        return sorted(s.getPath().getName().removeprefix("run_id=") for s in self._fs.listStatus(folder))


def _mapped(rows: DataFrame, column: str) -> bool:
    return "map<" in rows.schema[column].dataType.simpleString()
