"""Files that retrieval starts from and ends in, by Spark's own readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import whitespace_words

CHUNK = "id string, text string, doc_id string, position int, embedding array<double>, meta map<string,string>"
QREL = "query string, relevant_ids array<string>"
QUESTION = "query string, document_expected string"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks, one JSON object a line; lines that are none are skipped; a missing position is 0, missing meta an empty map."""
    rows = spark.read.schema(CHUNK).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("position", F.coalesce("position", F.lit(0))).withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))


def read_qrels(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``query, relevant_ids`` from one JSON array, or from an object a line."""
    return spark.read.schema(QREL).option("multiLine", not lines).json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """``query, document_expected`` from files of one JSON array each; items that lack either are left out."""
    return spark.read.schema(QUESTION).option("multiLine", True).json(path).where("query IS NOT NULL AND document_expected IS NOT NULL")


def read_text_dir(spark: SparkSession, path: str, pattern: str = "*.txt", least_chars: int = 0, least_words: int = 0, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """``doc, text, folder``: a row per file of more than ``least_chars`` characters and at least ``least_words`` words.

    Bytes that are no UTF-8 (with or without its mark) are read as Latin-1, which any bytes are. ``fraction`` samples the files.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    raw = raw if fraction is None else raw.sample(fraction, seed)
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    parts = F.split("path", "/")
    out = raw.select(F.element_at(parts, -1).alias("doc"), F.regexp_replace(text, "^\ufeff", "").alias("text"), F.element_at(parts, -2).alias("folder"))
    return out.where((F.length(F.trim("text")) > least_chars) | F.lit(least_chars <= 0)).where(F.size(whitespace_words(F.col("text"))) >= least_words)


def write_lines(df: DataFrame, path: str) -> None:
    """A JSON object a line, null fields included (training pairs, results)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_md(df: DataFrame, path: str, order: list[str]) -> None:
    """A report's few rows as one Markdown table, in order."""
    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    names = df.columns
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(names)} |"), (1, f"|{'---|' * len(names)}")], "_place int, value string")
    rows = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id() + 2).select("_place", line([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]).alias("value"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("_place").select("value").write.mode("overwrite").text(path)


def models(paths: DataFrame) -> DataFrame:
    """``path`` -> ``kind, model, number, rank``: folders named ``<kind>/model-<number>``, in order of the number; others are left out."""
    made = paths.select("path", F.regexp_extract("path", "([^/]+)/(model-[^/]+)/?$", 1).alias("kind"), F.regexp_extract("path", "([^/]+)/(model-[^/]+)/?$", 2).alias("model")).where("model <> ''")
    number = F.try_to_number(F.replace(F.regexp_extract("model", "model-([0-9_.]+)", 1), F.lit("_"), F.lit(".")), F.lit("999999999999D999999")).cast("double")
    return made.withColumn("number", number).select("kind", "model", "number", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("number").asc_nulls_last(), "model")).alias("rank"))


def merged(texts: DataFrame) -> DataFrame:
    """``name, text`` -> ``name, place, line``: a banner and the lines of each text; sorted by name and place they are the merged file."""
    banner = F.array(F.lit("=" * 80), F.concat(F.lit("FILE: "), F.col("name")), F.lit("=" * 80))
    return texts.select("name", F.posexplode(F.concat(banner, F.split(F.coalesce("text", F.lit("")), "\n"))).alias("place", "line"))


def save_config(spark: SparkSession, config: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(config, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """``defaults`` with what the file says; unknown keys and fusion weights that don't sum to 1 are errors."""
    made = json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))  # one small file
    unknown = made.keys() - defaults.keys()
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    out = {**defaults, **made}
    if "fusion" in out and abs(sum(out["fusion"].values()) - 1) > 0.01:
        raise ValueError("fusion weights must sum to 1")
    if out.get("k_prime", 0) < out.get("k", 0):
        raise ValueError("k_prime must be at least k")
    return out
