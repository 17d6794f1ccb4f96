"""The corpus pipeline: toxicity, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's rows as Parquet in the shared checkpoint folder and reads them
again, so a lost executor never costs more than the stage at hand.

Defined results: a null text counts as empty; rows that repeat an id are judged by their own text; a row without an
id goes where a row with one has its text, and it neither is nor has a near copy; a stage that keeps nothing, or an empty table, leaves the next ones
an empty table; other columns are carried along to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import queries as llm
from rankforge.llm._base import free_name, release, stored, table
from rankforge.llm.exact_dedup import drop_exact_copies
from rankforge.llm.mixing import mix
from rankforge.llm.near_copies import drop_near_copies
from rankforge.llm.packing import pack
from rankforge.llm.toxicity import drop_toxic, train

#: A stage's models, tokenizers and shares of words are no SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the ordinal model calls toxic go."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the smallest doc_id stays."""
    release(spark)  # what the stages before have left in shuffles
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, which may be never; ids may repeat or be null, and columns may have any names."""
    release(spark)
    row, copies = free_name(docs, "_mix_row"), free_name(docs, "_mix_copies")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "mixing-rows")
    taken = mix(rows.select("doc_id", "source", "text", F.col(row).alias("_mixed")), keep=["_mixed"]).where("copies > 0")
    joined = rows.join(taken.select(F.col("_mixed").alias(row), F.col("copies").alias(copies)), row)
    return joined.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    release(spark)
    return pack(docs, llm._tokenizer())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
