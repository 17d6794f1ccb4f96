"""Queries of files: the driver's tables are written to a fresh shared folder and read by the engine's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.keep import fresh_path
from ..sources import files, npz, synthetic
from .common import qrels, table
from .registry import query


def fresh(spark, label):
    return fresh_path(spark, label)


@query("src_chunks_jsonl", "SELECT doc_id::VARCHAR AS id, source AS doc_id, doc_id % 10 AS position, md5(text) AS digest, len(embedding) AS dims FROM documents LEFT JOIN embeddings ON vec_id = documents.doc_id WHERE text IS NOT NULL")
def src_chunks_jsonl(spark, sf):
    """A line that is no JSON stands after each chunk and is skipped."""
    d = table(spark, sf, "documents").where("text IS NOT NULL").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    chunk = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text", F.col("source").alias("doc_id"), (F.col("doc_id") % 10).alias("position"), "embedding"))
    path = fresh(spark, "chunks")
    d.select(F.explode(F.array(chunk, F.lit("{no json"))).alias("value")).write.text(path)
    return files.read_chunks(spark, path).select("id", "doc_id", "position", F.md5("text").alias("digest"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))


@query("src_qrels_jsonl", "SELECT b.item_id::VARCHAR AS query, d.doc_id::VARCHAR AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def src_qrels_jsonl(spark, sf):
    """A JSON object a line: a query with its relevant ids."""
    path = fresh(spark, "qrels")
    ids = F.collect_list(F.col("chunk_id").cast("string")).alias("relevant_ids")  # a passage's own
    qrels(spark, sf).groupBy(F.col("query_id").cast("string").alias("query")).agg(ids).write.json(path)
    return files.read_qrels(spark, path, lines=True).select("query", F.explode("relevant_ids").alias("id"))


@query("src_benchmark_json", "SELECT text AS query, item_id::VARCHAR AS document_expected FROM benchmark WHERE item_id % 7 <> 3")
def src_benchmark_json(spark, sf):
    """Files of one array each; every seventh item lacks its document and is left out."""
    path = fresh(spark, "questions")
    item = F.struct(F.col("text").alias("query"), F.when(F.col("item_id") % 7 != 3, F.col("item_id").cast("string")).alias("document_expected"))
    arrays = table(spark, sf, "benchmark").groupBy((F.col("item_id") % 4).alias("part")).agg(F.to_json(F.collect_list(item)).alias("value"))  # one file each
    arrays.write.partitionBy("part").text(path)
    return files.read_questions(spark, path + "/part=*")


def _pages(spark, sf):
    path = fresh(spark, "texts")
    table(spark, sf, "pages").select("page_id", F.col("html").alias("value")).where("html IS NOT NULL").write.partitionBy("page_id").text(path)
    return path


_NAME = "regexp_extract(folder, 'page_id=(.*)', 1)"


@query("src_text_dir", "SELECT page_id, md5(html || chr(10)) AS digest FROM pages WHERE length(trim(html || chr(10))) > 10")
def src_text_dir(spark, sf):
    """A file per page; those of at most 10 characters are left out."""
    t = files.read_text_dir(spark, _pages(spark, sf), least_chars=10)
    return t.select(F.expr(_NAME).cast("long").alias("page_id"), F.md5("text").alias("digest"))


@query("src_text_encoding_fallback", r"SELECT page_id, len(list_filter(regexp_split_to_array(html, '\s+'), lambda x: x <> '')) AS n_words FROM pages WHERE len(list_filter(regexp_split_to_array(html, '\s+'), lambda x: x <> '')) >= 20")
def src_text_encoding_fallback(spark, sf):
    """Texts of at least 20 words, read as UTF-8 or else Latin-1."""
    t = files.read_text_dir(spark, _pages(spark, sf), least_words=20)
    return t.select(F.expr(_NAME).cast("long").alias("page_id"), F.size(files.whitespace_words(F.col("text"))).alias("n_words"))


@query("src_results_csv", "SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def src_results_csv(spark, sf):
    path = fresh(spark, "results")
    files.write_csv(table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), path)
    back = files.read_csv(spark, path, "doc_id long, lang string, source string, n_chars long")
    return back.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("sink_json", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def sink_json(spark, sf):
    path = fresh(spark, "json")
    files.write_lines(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return spark.read.schema("doc_id long, lang string, text string").json(path).select("doc_id", "lang", F.md5("text").alias("digest"))


@query("sink_md", "SELECT line FROM (SELECT '| lang | n |' AS line UNION ALL SELECT '|---|---|' UNION ALL SELECT '| ' || coalesce(lang, '') || ' | ' || count(*) || ' |' FROM documents GROUP BY lang)")
def sink_md(spark, sf):
    path = fresh(spark, "md")
    files.write_md(table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), path, ["lang"])
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("sink_npz", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]) + 1e-10, 6) + 0.0 AS total FROM embeddings")
def sink_npz(spark, sf):
    """Arrays are kept as a Parquet table."""
    path = fresh(spark, "arrays")
    table(spark, sf, "embeddings").write.parquet(path)
    return spark.read.parquet(path).select("vec_id", F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("src_npz", "SELECT vec_id, round(list_sum(embedding::DOUBLE[]) + 1e-10, 6) + 0.0 AS total, 'whole' AS expansion, 64 AS dims FROM embeddings WHERE embedding IS NOT NULL")
def src_npz(spark, sf):
    """Vectors with their keys and configuration, written as archives and read back, each archive by its own task."""
    npz.register(spark)
    path = fresh(spark, "npz")
    rows = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>"))
    rows.write.format("npz").option("config", '{"expansion": "whole", "dims": 64}').mode("append").save(path)
    back = spark.read.format("npz").load(path)
    one = lambda name: back.where(F.col("array") == name)
    keys = one("embeddings_keys").select("file", "row", F.get("numbers", F.lit(0)).cast("long").alias("vec_id"))
    config = one("embeddings_config").select("file", F.from_json(F.get("texts", F.lit(0)), "expansion string, dims int").alias("c"))
    total = F.aggregate("numbers", F.lit(0.0), lambda a, x: a + x).alias("total")
    return one("embeddings").select("file", "row", total).join(keys, ["file", "row"]).join(config, "file").select("vec_id", "total", "c.expansion", "c.dims")


@query("src_models_dir", "SELECT kind, model, number, row_number() OVER (PARTITION BY kind ORDER BY number, model) AS rank FROM (SELECT source AS kind, 'model-0_' || lpad((doc_id * 7 % 9973)::VARCHAR, 4, '0') AS model, ('0.' || lpad((doc_id * 7 % 9973)::VARCHAR, 4, '0'))::DOUBLE AS number FROM documents)", "number")
def src_models_dir(spark, sf):
    name = F.concat(F.lit("/models/"), F.col("source"), F.lit("/model-0_"), F.lpad((F.col("doc_id") * 7 % 9973).cast("string"), 4, "0"))
    return files.models(table(spark, sf, "documents").select(name.alias("path")))


@query("merge_text_files", "SELECT doc_id::VARCHAR AS name, 3 + len(string_split(coalesce(text, ''), chr(10))) AS n_lines, md5(repeat('=', 80) || chr(10) || 'FILE: ' || doc_id || chr(10) || repeat('=', 80) || chr(10) || coalesce(text, '')) AS digest FROM documents")
def merge_text_files(spark, sf):
    """Each file's lines under its banner; a digest stands for them."""
    lines = files.merged(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), "text"))
    own = F.sort_array(F.collect_list(F.struct("place", "line")))  # one file's lines
    return lines.groupBy("name").agg(F.count(F.lit(1)).alias("n_lines"), F.md5(F.array_join(F.transform(own, lambda x: x["line"]), "\n")).alias("digest"))


#: The defaults of a configuration.
DEFAULTS = {"k": 30, "k_prime": 100, "mu": 1500.0, "window": 8, "fusion": {"embedding": 0.45, "ppr": 0.25, "qlm": 0.2, "mrf": 0.1}}


def config_io(spark, sf):
    path = fresh(spark, "config")
    files.save_config(spark, {"k": 3, "k_prime": 10}, path)
    made = files.load_config(spark, path, DEFAULTS)
    return spark.createDataFrame([(n, made[n]) for n in ("k", "k_prime", "window")], "name string, value long")


def src_synthetic_chunks(spark, sf):
    return synthetic.chunks(spark, 100).select("id", "doc_id", "position", F.size("embedding").alias("dims"), F.col("meta")["category"].alias("category"))


def src_synthetic_qrels(spark, sf):
    """About a fifth of the chunks for each of five queries; by Spark's hash, which SQL elsewhere lacks."""
    return synthetic.qrels(synthetic.chunks(spark, 100))
