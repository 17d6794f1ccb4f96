"""A training set as a folder: ``pairs`` (JSON lines by split), ``chunks`` (JSON lines) and ``metadata`` (one line that describes both)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keep import stored

PAIR = "anchor string, positive string, negative string, difficulty double, type string, ids struct<anchor:bigint,positive:bigint,negative:bigint>, split string"
CHUNK = "chunk_id bigint, doc_id bigint, text string, position double, length bigint, chunk_index bigint, total_chunks bigint, unique_terms array<string>"
METADATA = "total_chunks bigint, total_documents bigint, chunk_size int, overlap int, min_chunk_words int, splits map<string,bigint>, pair_types map<string,bigint>"


def write_training_set(pairs: DataFrame, chunks: DataFrame, path: str, settings: dict[str, int]) -> str:
    """Writes ``pairs`` (columns of ``PAIR``) and ``chunks`` (columns of ``CHUNK``) below ``path``, which must not exist; returns it.

    What the description counts is counted over what was written. Null fields are written as null; empty tables give empty
    folders and a description of zeros; a null split is a split of its own, which the description leaves out.
    """
    pairs, spark = stored(pairs, "pairs"), pairs.sparkSession
    pairs.write.partitionBy("split").option("ignoreNullFields", False).json(f"{path}/pairs")
    chunks.write.option("ignoreNullFields", False).json(f"{path}/chunks")
    kept = read_training_chunks(spark, path).agg(F.count(F.lit(1)).alias("total_chunks"), F.count_distinct("doc_id").alias("total_documents"))
    counts = lambda rows, by, name: rows.where(F.col(by).isNotNull()).groupBy(by).count().agg(F.map_from_entries(F.collect_list(F.struct(by, "count"))).alias(name))  # noqa: E731  few kinds
    made = kept.crossJoin(counts(pairs, "split", "splits")).crossJoin(counts(pairs.where("split = 'train'"), "type", "pair_types"))  # a row each
    made.select("total_chunks", "total_documents", *[F.lit(v).alias(k) for k, v in settings.items()], "splits", "pair_types").coalesce(1).write.json(f"{path}/metadata")
    return path


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR).json(f"{path}/pairs")


def read_training_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(f"{path}/chunks")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).json(f"{path}/metadata")
