"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach: the session's spark.checkpoint.dir.

    On one machine, as in tests, a session without it gets a folder of its own; a
    cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path and sc.getCheckpointDir() is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="quarry-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return (path or sc.getCheckpointDir()).rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_scratch() -> None:
    for spark, path in _made:
        try:
            drop(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            return


atexit.register(_drop_scratch)


def saved(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """`df` as a Parquet table, without the shuffle files that made it: losing executors loses nothing of it."""
    spark = df.sparkSession
    writer = df.write.option("compression", "zstd")
    clean, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:
        before = spark.conf.get(clean, "false")
        spark.conf.set(clean, "true")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(clean, before or "false")
    table = spark.read.schema(df.schema).parquet(path)
    return table.select(*[f"`{c}`" for c in df.columns]) if partition_by else table  # those it's parted by come last


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes with the application."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """`df` as a table of the shared folder that goes with the application."""
    return saved(df, scratch(df.sparkSession, name), *partition_by)
