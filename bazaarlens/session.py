"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app: str = "bazaarlens", **more: str) -> SparkSession:
    """A session with the settings above; ``more`` adds or overrides."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: the session's ``spark.checkpoint.dir``; only on one machine,
    where that is unset, one of this process."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="bazaarlens-"))
    return _local[0]


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from its checkpoint after that: what several results start
    from.  The folder is ``shared_dir``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once, as ``settled``, but in columns: less to write where rows are many, later steps read only
    the columns that they need, and joins know its size."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its keys to all shuffle partitions.  Adaptive execution joins partitions by their compressed
    bytes, which puts millions of short rows that are alike into one task; these are left as they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
