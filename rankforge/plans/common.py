"""The driver's tables as chunks, queries and vectors, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators.lexical import Index
from ..operators.ranking import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, doc, text``: a document is a chunk of its source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), "text")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, doc, position``: chunks numbered from 0 inside their source."""
    made = numbered(chunks(spark, sf_dir).select("chunk_id", "doc"), ["doc"], [F.col("chunk_id")], "position")
    return made.withColumn("position", F.col("position") - 1)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def spread(df: DataFrame) -> DataFrame:
    """In at least as many parts as there are cores, where a table of few files would leave most of them idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(texts(spark, sf_dir)).select("chunk_id", tokenize(F.col("text")).alias("tokens"))


def index(spark: SparkSession, sf_dir: str) -> Index:
    return Index(asked(spark, sf_dir).select("query_id", tokenize(F.col("text")).alias("tokens")), tokens(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chunk_id, v``: null where a document has no vector."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("chunk_id"), "v")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")).join(v, "chunk_id", "left")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, chunk_id``: documents that hold the query's passage.

    The passage's words are hashed in windows of its first 8, which only documents with these share; the
    containment test then sees few pairs. Passages of fewer words are tested against all.
    """
    d, q = texts(spark, sf_dir), asked(spark, sf_dir)
    head = lambda c: F.filter(F.split(c, " "), lambda x: x != "")
    short = q.where(F.size(head(F.col("text"))) < 10)
    grams = lambda words, n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " ")))
    inner = lambda w: F.slice(w, 2, 8)  # noqa: E731  the first word may be glued to what stands before it
    ask = q.where(F.size(head(F.col("text"))) >= 10).select("query_id", F.col("text").alias("passage"), F.xxhash64(F.array_join(inner(head(F.col("text"))), " ")).alias("h"))
    once = d.select("chunk_id", F.explode(F.array(head(F.col("text")))).alias("w"))  # a generator's output isn't worked out again for each window
    has = once.select("chunk_id", F.explode(F.array_distinct(grams(F.col("w"), 8))).alias("h")).join(ask.select("h").distinct(), "h", "left_semi")
    found = has.join(ask, "h").join(d, "chunk_id").where(F.contains("text", "passage")).select("query_id", "chunk_id")
    rest = d.join(F.broadcast(short.select("query_id", F.col("text").alias("passage"))), F.contains("text", F.col("passage"))).select("query_id", "chunk_id")
    return found.unionByName(rest).distinct()


def toks(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"


#: Common table expressions of the oracles.
CTE = f"""
    c AS MATERIALIZED (SELECT doc_id AS chunk_id, source AS doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, text, {toks('text')} AS toks FROM documents),
    q AS (SELECT item_id AS query_id, text, {toks('text')} AS toks FROM benchmark),
    post AS MATERIALIZED (SELECT chunk_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM c),
    tf AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM post GROUP BY ALL),
    dl AS (SELECT chunk_id, len(toks) AS dl FROM c),
    cf AS (SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM tf GROUP BY term),
    tot AS (SELECT greatest(sum(dl), 1)::DOUBLE AS total, count(*) AS n_chunks, avg(dl) AS avg_dl FROM dl),
    qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest(toks) AS term FROM q) GROUP BY ALL),
    ql AS (SELECT query_id, len(toks) AS n FROM q),
    pairs AS (SELECT query_id, n, chunk_id, dl FROM ql CROSS JOIN dl)
"""


def mrf_cte(*windows: int) -> str:
    """Query bigrams, chunk pairs and features of the dependence model for these windows."""
    reach = max(windows)
    return (
        CTE
        + f""",
    qp AS MATERIALIZED (SELECT query_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM q),
    hit AS MATERIALIZED (SELECT post.* FROM post SEMI JOIN qp USING (term)),
    qb AS (SELECT a.query_id, a.term AS a, b.term AS b, count(*) AS times FROM qp a JOIN qp b ON a.query_id = b.query_id AND b.pos = a.pos + 1 GROUP BY ALL),
    qbn AS (SELECT query_id, sum(times) AS n_pairs FROM qb GROUP BY ALL),
    near AS MATERIALIZED (SELECT chunk_id, term AS x, d, lead_term AS y FROM (SELECT chunk_id, term, pos, unnest(range(1, {reach + 1})) AS d FROM hit) h
        JOIN (SELECT chunk_id AS c2, term AS lead_term, pos AS p2 FROM hit) l ON l.c2 = h.chunk_id AND l.p2 = h.pos + h.d),
    cb AS (SELECT DISTINCT chunk_id, x AS a, y AS b FROM near WHERE d = 1),
    gaps AS MATERIALIZED (SELECT chunk_id, least(x, y) AS a, greatest(x, y) AS b, min(d) AS gap FROM near GROUP BY ALL),
    uni AS (SELECT query_id, chunk_id, sum(qn) AS hit, sum(qn * tf) AS f FROM qt JOIN tf USING (term) GROUP BY ALL),
    unigram AS MATERIALIZED (SELECT query_id, chunk_id, n, least(1.0, coalesce(hit::DOUBLE / n, 0.0) + least(0.1, ln(1.0 + coalesce(f, 0)) / 10)) AS u, coalesce(hit::DOUBLE / n, 0.0) AS cov FROM pairs LEFT JOIN uni USING (query_id, chunk_id)),
    oh AS (SELECT query_id, chunk_id, sum(times) AS hit FROM qb JOIN cb USING (a, b) GROUP BY ALL),
    ordered AS MATERIALIZED (SELECT query_id, chunk_id, coalesce(hit::DOUBLE / n_pairs, 0.0) AS o FROM pairs LEFT JOIN qbn USING (query_id) LEFT JOIN oh USING (query_id, chunk_id)),
    wins AS (SELECT unnest({list(windows)}) AS w),
    qu AS MATERIALIZED (SELECT DISTINCT w, a.query_id, least(a.term, b.term) AS a, greatest(a.term, b.term) AS b FROM wins, qp a JOIN qp b ON a.query_id = b.query_id AND b.pos > a.pos AND b.pos <= a.pos + {reach} WHERE b.pos - a.pos <= w),
    qun AS (SELECT w, query_id, count(*) AS n_pairs FROM qu GROUP BY ALL),
    wh AS MATERIALIZED (SELECT qu.w, query_id, chunk_id, count(*) AS hit FROM qu JOIN gaps ON qu.a = gaps.a AND qu.b = gaps.b WHERE gap <= qu.w GROUP BY ALL),
    feat AS (SELECT wins.w, p.query_id, p.chunk_id, p.n, u, cov, o, coalesce(wh.hit::DOUBLE / qun.n_pairs, 0.0) AS x FROM unigram p JOIN ordered USING (query_id, chunk_id) CROSS JOIN wins
             LEFT JOIN qun ON qun.w = wins.w AND qun.query_id = p.query_id
             LEFT JOIN wh ON wh.w = wins.w AND wh.query_id = p.query_id AND wh.chunk_id = p.chunk_id)
"""
    )
