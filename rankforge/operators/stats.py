"""Corpus statistics over ``tokens(chunk_id, tokens)`` frames, kept as tables rather than dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .keep import stored


def token_table(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", tokenizer=tokenize) -> DataFrame:
    """``id_col, tokens``."""
    return chunks.select(F.col(id_col), tokenizer(F.col(text_col)).alias("tokens"))


def postings(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``id_col, pos, term``. The outer generator keeps the tokenizer from being evaluated a second time in the scan."""
    return tokens.select(id_col, F.posexplode_outer("tokens").alias("pos", "term")).where("term IS NOT NULL")


def chunk_term_freqs(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return postings(tokens, id_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_freqs(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return postings(tokens, id_col).groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def doc_freqs(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Distinct terms are taken inside each row, so one exchange is enough."""
    once = tokens.select(id_col, F.explode_outer(F.array_distinct("tokens")).alias("term")).where("term IS NOT NULL")
    return once.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def chunk_lengths(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return tokens.select(id_col, F.size("tokens").cast("long").alias("dl"))


def term_stats(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``term, cf, df`` in one pass."""
    return chunk_term_freqs(tokens, id_col).groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def corpus_statistics(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """One row: ``total_tokens, vocab_size, n_chunks, avg_dl``; zeros for an empty corpus."""
    lengths = chunk_lengths(tokens, id_col).agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"), F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl"))
    return lengths.crossJoin(term_freqs(tokens, id_col).agg(F.count(F.lit(1)).alias("vocab_size")))  # one row each


def idf_scores(tokens: DataFrame, id_col: str = "chunk_id", log: bool = False) -> DataFrame:
    """(N - df + 0.5) / (df + 0.5), without a logarithm unless asked for."""
    n = chunk_lengths(tokens, id_col).agg(F.count(F.lit(1)).alias("n"))
    ratio = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    return doc_freqs(tokens, id_col).crossJoin(F.broadcast(n)).select("term", (F.ln(ratio) if log else ratio).alias("idf"))


def tfidf_scores(tokens: DataFrame, id_col: str = "chunk_id", log: bool = False) -> DataFrame:
    tf = chunk_term_freqs(tokens, id_col)
    return tf.join(idf_scores(tokens, id_col, log), "term", "left").select(id_col, "term", (F.col("tf") * F.coalesce("idf", F.lit(0.0))).alias("tfidf"))


def term_probabilities(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    total = chunk_lengths(tokens, id_col).agg(F.greatest(F.coalesce(F.sum("dl"), F.lit(0)), F.lit(1)).alias("total"))
    return term_freqs(tokens, id_col).crossJoin(F.broadcast(total)).select("term", (F.col("cf") / F.col("total")).alias("p"))


def chunk_specific_stats(tokens: DataFrame, corpus: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``dl, n_unique, n_unseen, mean_p``: against the term probabilities of another corpus ``corpus(term, p)``."""
    per = chunk_term_freqs(tokens, id_col).join(corpus, "term", "left").groupBy(id_col)
    agg = per.agg(F.count(F.lit(1)).alias("n_unique"), F.sum(F.col("p").isNull().cast("long")).alias("n_unseen"), F.avg(F.coalesce("p", F.lit(0.0))).alias("mean_p"))
    out = chunk_lengths(tokens, id_col).join(agg, id_col, "left")
    return out.select(id_col, "dl", *[F.coalesce(c, F.lit(z)).alias(c) for c, z in (("n_unique", 0), ("n_unseen", 0), ("mean_p", 0.0))])


def term_totals(tokens: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``term, cf, df`` as ``term_stats`` gives them; only totals of a task and term are exchanged.

    Distinct terms are taken inside each row; only of ids that repeat are the terms of all rows brought together.
    """
    again = stored(tokens.groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again"), "again")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    count = lambda cf, df: lambda t: F.struct(t.alias("term"), cf.alias("cf"), df.alias("df"))
    both = lambda ts: F.concat(F.transform(ts, count(one, none)), F.transform(F.array_distinct(ts), count(none, one)))
    inside = lambda rows: rows.select(F.explode(F.flatten(F.transform(F.array("tokens"), both))).alias("t")).select("t.*")  # noqa: E731  tokens are made once
    if again.isEmpty():
        counts = inside(tokens)
    else:
        same = F.col(id_col).eqNullSafe(F.col("_again"))
        shared = chunk_term_freqs(tokens.join(again, same, "left_semi"), id_col)
        counts = inside(tokens.join(again, same, "left_anti")).unionByName(shared.select("term", F.col("tf").alias("cf"), one.alias("df")))
    return counts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def tfidf_smooth(tokens: DataFrame, id_col: str = "chunk_id", min_df: int | None = None, max_df: float = 0.95, max_features: int | None = None) -> DataFrame:
    """Sublinear tf, smoothed idf, unit rows: ``id_col, term, weight`` over the most frequent terms (ties by term).

    Unless given, a term must be in two chunks where there are over 1000 (else in one), and half as many terms as chunks are
    taken, 5000 at most. Tokens should come without accents (``strip_accents``).
    """
    n = chunk_lengths(tokens, id_col).agg(F.count(F.lit(1)).alias("n"))
    terms = term_totals(tokens, id_col).crossJoin(F.broadcast(n))
    least = F.when(F.col("n") > 1000, 2).otherwise(1) if min_df is None else F.lit(min_df)
    most = max(1, min(5000, tokens.count() // 2)) if max_features is None else max_features
    kept = terms.where((F.col("df") >= least) & (F.col("df") <= max_df * F.col("n"))).orderBy(F.desc("cf"), "term").limit(most)
    idf = F.broadcast(stored(kept.select("term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf"))  # at most max_features rows
    own = postings(tokens, id_col).join(idf.select("term"), "term", "left_semi").repartition(F.col(id_col))  # the one exchange of chunks: counts and norms stay where it puts them
    tf = own.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(idf, "term").select(id_col, "term", ((1 + F.ln("tf")) * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def top_unique_terms(weights: DataFrame, id_col: str = "chunk_id", k: int = 5, weight: str = "weight") -> DataFrame:
    order = Window.partitionBy(id_col).orderBy(F.desc(F.round(weight, 6)), "term")
    return weights.where(F.col(weight) > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
