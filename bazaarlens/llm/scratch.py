"""Written intermediate tables in the folder that the cluster's machines share.

Each table cuts lineage: what follows reads files, so a lost executor costs a re-read and not
a recomputation.  The folder is ``spark.checkpoint.dir`` of the session; only where that is
unset and Spark runs on one machine (as in tests) a local folder is made.

Rows that are told apart by a number get it here, once, and are written with it: a second
``monotonically_increasing_id`` over the same files may number them otherwise, as how files are
split depends on the cores that are there.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file of a table whose size is known.
FILE_ROWS = 500_000
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; on one machine, else one local folder for this process."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="bazaarlens-"))
    return _local[0]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until it is not a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """A folder of its own under the shared one, for the tables of one operator's run."""

    def __init__(self, spark: SparkSession, owner: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, most: int | None = None) -> DataFrame:
        """Write ``df`` as Parquet and read it back; in files of about ``FILE_ROWS`` rows where it is
        known to have ``most`` rows at most, as a small table in many files is slow to write."""
        if most is not None:
            df = df.coalesce(most // FILE_ROWS + 1)
        df.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def numbered(self, df: DataFrame, row: str, name: str = "numbered") -> DataFrame:
        """``df`` written with a number for each row in the column ``row``."""
        return self.table(df.withColumn(row, F.monotonically_increasing_id()), name)

    def bucketed(self, df: DataFrame, key: str, name: str, dealt: bool = False) -> DataFrame:
        """Write ``df`` in buckets of ``key``, as many as the session has shuffle partitions:
        joins by ``key`` with shuffled rows leave it where it is.  ``dealt``: it comes from buckets already."""
        buckets, entry = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"scratch_{uuid.uuid4().hex}"
        writer = (df if dealt else df.repartition(buckets, key)).write.option("compression", "zstd").option("path", f"{self.path}/{name}")
        writer.bucketBy(buckets, key).format("parquet").saveAsTable(entry)
        out = self.spark.table(entry)
        self.spark.sql(f"DROP TABLE {entry}")  # only the name: the files are in the shared folder
        return out

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps: it does so when the driver's
        garbage collection finds that no plan needs them any more."""
        gc.collect()
        self.spark._jvm.System.gc()
