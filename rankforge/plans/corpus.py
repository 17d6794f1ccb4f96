"""Queries of corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, stats
from .common import CTE, asked, chunks, index, table, tokens
from .registry import query


@query("term_freqs", f"WITH {CTE} SELECT term, cf FROM cf")
def term_freqs(spark, sf):
    return stats.term_freqs(tokens(spark, sf))


@query("doc_freqs", f"WITH {CTE} SELECT term, df FROM cf")
def doc_freqs(spark, sf):
    return stats.doc_freqs(tokens(spark, sf))


@query("chunk_lengths", f"WITH {CTE} SELECT chunk_id, dl FROM dl")
def chunk_lengths(spark, sf):
    return stats.chunk_lengths(tokens(spark, sf))


@query("corpus_statistics", f"WITH {CTE} SELECT sum(dl)::BIGINT AS total_tokens, count(*) AS n_chunks, avg(dl) AS avg_dl, (SELECT count(*) FROM cf) AS vocab_size FROM dl", "avg_dl")
def corpus_statistics(spark, sf):
    return stats.corpus_statistics(tokens(spark, sf))


@query("chunk_term_freqs", f"WITH {CTE} SELECT chunk_id, term, tf FROM tf")
def chunk_term_freqs(spark, sf):
    return stats.chunk_term_freqs(tokens(spark, sf))


@query("avg_doc_length", f"WITH {CTE} SELECT coalesce(avg(dl), 0.0) AS avg_dl FROM dl", "avg_dl")
def avg_doc_length(spark, sf):
    return stats.chunk_lengths(tokens(spark, sf)).agg(F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))


@query("idf_scores", f"WITH {CTE} SELECT term, (n_chunks - df + 0.5) / (df + 0.5) AS idf FROM cf CROSS JOIN tot", "idf")
def idf_scores(spark, sf):
    return stats.idf_scores(tokens(spark, sf))


@query("tfidf_scores", f"WITH {CTE} SELECT chunk_id, term, tf * (n_chunks - df + 0.5) / (df + 0.5) AS tfidf FROM tf JOIN cf USING (term) CROSS JOIN tot", "tfidf")
def tfidf_scores(spark, sf):
    return stats.tfidf_scores(tokens(spark, sf))


@query("vocabulary", f"WITH {CTE} SELECT term FROM cf")
def vocabulary(spark, sf):
    return stats.postings(tokens(spark, sf)).select("term").distinct()


@query("distinct_terms", f"WITH {CTE} SELECT count(*) AS n_terms FROM cf")
def distinct_terms(spark, sf):
    return stats.postings(tokens(spark, sf)).select("term").distinct().agg(F.count(F.lit(1)).alias("n_terms"))


@query("distinct_pairs", f"WITH {CTE} SELECT count(*) AS n_pairs FROM (SELECT DISTINCT a.term, b.term FROM post a JOIN post b ON a.chunk_id = b.chunk_id AND b.pos = a.pos + 1)")
def distinct_pairs(spark, sf):
    from ..functions.text import bigrams_ordered

    return tokens(spark, sf).select(F.explode(bigrams_ordered(F.col("tokens"))).alias("g")).distinct().agg(F.count(F.lit(1)).alias("n_pairs"))


@query("term_probabilities", f"WITH {CTE} SELECT term, cf / total AS p FROM cf CROSS JOIN tot", "p")
def term_probabilities(spark, sf):
    return stats.term_probabilities(tokens(spark, sf))


@query("corpus_lookup", f"WITH {CTE} SELECT query_id, term, coalesce(cf / total, 0.0) AS p FROM qt LEFT JOIN cf USING (term) CROSS JOIN tot", "p")
def corpus_lookup(spark, sf):
    p = stats.term_probabilities(tokens(spark, sf))
    return index(spark, sf).query_terms.join(p, "term", "left").select("query_id", "term", F.coalesce("p", F.lit(0.0)).alias("p"))


@query(
    "chunk_specific_stats",
    f"""WITH {CTE}, qc AS (SELECT query_id, sum(qn)::BIGINT AS dl, count(*) AS n_unique, count(*) FILTER (WHERE cf IS NULL) AS n_unseen, avg(coalesce(cf / total, 0.0)) AS mean_p
        FROM qt LEFT JOIN cf USING (term) CROSS JOIN tot GROUP BY ALL) SELECT * FROM qc""",
    "mean_p",
)
def chunk_specific_stats(spark, sf):
    """Statistics of the benchmark passages against the documents' term probabilities."""
    own = stats.token_table(asked(spark, sf), "query_id")
    return stats.chunk_specific_stats(own, stats.term_probabilities(tokens(spark, sf)), "query_id").where("dl > 0")


_PLAIN = r"list_filter(regexp_split_to_array(lower(strip_accents(coalesce(text, ''))), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
_TFIDF = f"""a AS (SELECT doc_id AS chunk_id, unnest({_PLAIN}) AS term FROM documents), tf AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM a GROUP BY ALL), total AS (SELECT count(*) AS n FROM documents),
    terms AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tf GROUP BY term),
    kept AS MATERIALIZED (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT *, row_number() OVER (ORDER BY cf DESC, term) AS r FROM terms CROSS JOIN total WHERE df <= 0.95 * n AND df >= CASE WHEN n > 1000 THEN 2 ELSE 1 END) WHERE r <= least(5000, n // 2)),
    w AS (SELECT chunk_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN kept USING (term)),
    tfidf AS (SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS weight FROM w)"""


def plain_tokens(spark, sf):
    """Lower-cased tokens without accents."""
    from ..functions.text import strip_accents, tokenize

    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), tokenize(strip_accents(F.coalesce("text", F.lit("")))).alias("tokens"))


@query("tfidf_sklearn", f"WITH {_TFIDF} SELECT * FROM tfidf", "weight")
def tfidf_sklearn(spark, sf):
    return stats.tfidf_smooth(plain_tokens(spark, sf))


@query("top_unique_terms", f"WITH {_TFIDF} SELECT * FROM (SELECT chunk_id, term, weight, row_number() OVER (PARTITION BY chunk_id ORDER BY round(weight, 6) DESC, term) AS rank FROM tfidf WHERE weight > 0) WHERE rank <= 5", "weight")
def top_unique_terms(spark, sf):
    return stats.top_unique_terms(stats.tfidf_smooth(plain_tokens(spark, sf)))


@query("group_chunks_by_doc", "SELECT source AS doc, count(*) AS n_chunks, min(doc_id) AS first_chunk, max(doc_id) AS last_chunk FROM documents GROUP BY source")
def group_chunks_by_doc(spark, sf):
    return chunks(spark, sf).groupBy("doc").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


@query("union_languages", "SELECT lang, count(*) AS n FROM (SELECT 'query' AS lang, item_id FROM benchmark UNION ALL SELECT lang, doc_id FROM documents) GROUP BY lang")
def union_languages(spark, sf):
    q = table(spark, sf, "benchmark").select(F.lit("query").alias("lang"), F.col("item_id").alias("id"))
    return q.unionByName(table(spark, sf, "documents").select("lang", F.col("doc_id").alias("id"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("last_n_per_key", "SELECT user_id, event_id, ts, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10")
def last_n_per_key(spark, sf):
    return ranking.last_n_per_key(table(spark, sf, "events"), 10, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "ts", "rank")


@query("position_histogram", "SELECT turn AS position, count(*) AS n FROM conversations GROUP BY turn")
def position_histogram(spark, sf):
    return table(spark, sf, "conversations").groupBy(F.col("turn").alias("position")).agg(F.count(F.lit(1)).alias("n"))
