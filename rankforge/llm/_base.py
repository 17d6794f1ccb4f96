"""Shared helpers of the training-data operators: tables, durable checkpoints, text rules."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, as a Java/Python character class and as characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master, and an error on a cluster."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="rankforge-ckpt-")
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared checkpoint folder, so lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet under the shared checkpoint folder, until the session's JVM ends, and reads it back.

    Used where the columnar, compressed form is much smaller than a row checkpoint.
    """
    spark = df.sparkSession
    name = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(name)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more."""
    for df in tables:
        files = df.inputFiles()
        if files:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that no plan refers to any more.

    Its cleaner acts when the driver's garbage is collected, by itself every half hour only; an operator of
    several exchanges would hold the disk of all of them until then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_batches(frames, cols=2):
    """Arrow batches cut to about 4 MB of text, so that a task's memory doesn't follow its batch size."""
    for batch in frames:
        n, size = batch.num_rows, batch.nbytes
        step = max(1, n if size <= 4_000_000 else n * 4_000_000 // size)
        for at in range(0, n, step):
            yield batch.slice(at, step)


def join_by_size(left: DataFrame, right: DataFrame, keys: list[str], size: str, most: int = 10_000) -> DataFrame:
    """Inner join of ``left`` (stored, as it is read twice) with one row per key of ``right``, whose ``size`` counts the left rows it meets.

    At most ``most`` keys can hold more than a ``most``-th of all these rows each. They are broadcast, so their
    left rows stay where they are; no other key brings more than that share to one task.
    """
    total = right.agg(F.sum(size)).first()[0] or 0
    heavy = F.broadcast(right.where(F.col(size) * most > total))  # fewer than ``most`` rows
    rest = right.where(F.col(size) * most <= total)
    return left.join(heavy, keys).unionByName(left.join(heavy.select(*keys), keys, "left_anti").join(rest, keys))


def join_hot(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``join_by_size`` for a ``right`` that doesn't know how many rows of ``left`` each of its keys meets."""
    sizes = left.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    return join_by_size(left, right.join(sizes, key), [key], "_size").drop("_size")
