"""Queries of augmented texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import augment as A
from ..functions.text import normalize_doc_name, tokenize
from ..operators import evaluate as E
from ..operators.keep import stored
from ..operators.retrieval import Retrieval
from ..sources.synthetic import TEXTS
from .common import asked, qrels, spread, texts
from .registry import query


def _sql(label: str, i: int) -> str:
    options = ", ".join(f"'{o}'" for o in A.OPENINGS)
    return f"[{options}][('0x' || md5(doc_id || '/{label}{i}')[1:6])::BIGINT % {len(A.OPENINGS)} + 1]"


_CONTEXTS = f"""list_transform([t, {_sql('context', 0)} || t, {_sql('context', 1)} || t], x -> x) || CASE WHEN t LIKE '%?' THEN [{", ".join(f"'{x}' || lower(t)" for x in A.INDIRECT)}] ELSE ['¿' || t || '?', '¿Podrías explicarme ' || lower(t) || '?', '¿Cuál es la información sobre ' || lower(t) || '?'] END"""


def _numbered(df, variations):
    return df.select("chunk_id", F.posexplode(variations).alias("variant", "made"))


@query("augment_paraphrase")
def augment_paraphrase(spark, sf):
    d = texts(spark, sf).select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    return _numbered(d, A.paraphrases(F.col("text"), F.col("chunk_id").cast("string"), 3)).select("chunk_id", "variant", F.md5("made").alias("digest"))


@query("augment_context", f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), v AS (SELECT doc_id, {_CONTEXTS.replace("list_transform(", "").replace(", x -> x)", "")} AS xs FROM d), u AS (SELECT doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM v),
    o AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY doc_id, x), r AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS variant FROM o) SELECT doc_id AS chunk_id, variant, md5(x) AS digest FROM r WHERE variant <= 2""")
def augment_context(spark, sf):
    d = texts(spark, sf).select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    return _numbered(d, A.contexts(F.col("text"), F.col("chunk_id").cast("string"), 2)).select("chunk_id", "variant", F.md5("made").alias("digest"))


def corpus(spark, sf):
    """``chunk_id, variant, name, text``: each document, two paraphrases and one context at most, named after it."""
    return varied(texts(spark, sf))


def varied(d):
    d = d.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.col("chunk_id").cast("string")
    own = _numbered(d, A.paraphrases(F.col("text"), key, 2)).withColumn("kind", F.when(F.col("variant") == 0, "Original").otherwise(F.concat(F.lit("Paráfrasis "), F.col("variant").cast("string"))))
    led = _numbered(d, A.contexts(F.col("text"), key, 1)).where("variant > 0").withColumn("kind", F.concat(F.lit("Contexto "), F.col("variant").cast("string"))).withColumn("variant", F.col("variant") + 5)
    name = F.concat(F.lit("doc"), F.col("chunk_id").cast("string"), F.lit(" ("), F.col("kind"), F.lit(")"))
    return own.unionByName(led).select("chunk_id", "variant", name.alias("name"), F.col("made").alias("text"))


@query("augment_corpus")
def augment_corpus(spark, sf):
    return corpus(spark, sf).select("chunk_id", "variant", "name", F.md5("text").alias("digest"))


@query("augmented_eval")
def augmented_eval(spark, sf):
    """Likelihood over the augmented corpus; a variant counts for its document, which its name before the suffix tells."""
    d, rel = spread(texts(spark, sf)), stored(qrels(spark, sf), "relevant")
    coded = lambda df: varied(df).select((F.col("chunk_id") * 10 + F.col("variant")).alias("chunk_id"), tokenize(F.col("text")).alias("tokens"), normalize_doc_name(F.col("name")).alias("base"))
    base = rel.groupBy(F.concat(F.lit("doc"), F.col("chunk_id").cast("string")).alias("base")).agg(F.collect_set("query_id").alias("wanted"))  # the queries whose passage a document holds
    relevant = coded(d.join(rel.select("chunk_id").distinct(), "chunk_id", "left_semi")).join(base, "base").select("chunk_id", "tokens", "wanted")
    queries = asked(spark, sf).select("query_id", tokenize(F.col("text")).alias("tokens"), F.lit(0).alias("n_words"))
    return E.topn_accuracy(Retrieval(queries, coded(d).drop("base")).first_position(relevant), [])


def sample_sentences(spark, sf):
    """A thousand sentences: the samples, and each of four ways to introduce them."""
    times = 1000 // (5 * len(TEXTS))
    base = F.explode(F.array(*map(F.lit, TEXTS))).alias("base")
    rows = spark.range(times).select("id", base)
    forms = F.array("base", F.concat(F.lit("Variación "), (F.col("id") + 1).cast("string"), F.lit(": "), F.col("base")), *[F.concat(F.lit(x), F.col("base")) for x in ("Otro aspecto: ", "Perspectiva diferente: ", "Ejemplo concreto: ")])
    return rows.select("id", F.posexplode(forms).alias("form", "sentence"))
