"""Intermediate tables written once and read again, so that what several branches need is worked out once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder on a local master, and an error on a cluster."""
    context = spark.sparkContext
    jsc = context._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="rankforge-")
        context.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def deleted_on_exit(spark: SparkSession, name: str) -> str:
    """``name``, which goes when the session's JVM ends."""
    path, files = _path(spark, name)
    files.deleteOnExit(path)
    return name


def deleted(spark: SparkSession, name: str) -> None:
    path, files = _path(spark, name)
    files.delete(path, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder; what is written there goes when the session's JVM ends."""
    return deleted_on_exit(spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder until the session's JVM ends."""
    name = fresh_path(df.sparkSession, label)
    df.write.parquet(name)
    return df.sparkSession.read.schema(df.schema).parquet(name)
