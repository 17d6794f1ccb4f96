"""Queries of normalisation, fusion, ranking and the retrieval strategies.

Scores are rounded to nine digits before statistics of a group are taken of them, so that both engines see
the same ties and constants.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import tokenize, whitespace_words
from ..operators import fusion as N
from ..operators import ranking
from ..operators import retrieval as R
from ..operators.keep import stored
from .common import CTE, asked, chunk_vectors, chunks, index, mrf_cte, spread, table, texts, vectors
from .lexical import ENSEMBLE, KEYWORDS, OPTIMIZED
from .registry import query
from .vectors import QUERY_VECTOR, VEC, constant

BY = ["query_id"]
#: Embedding scores alone.
EMBEDDINGS = f"""{CTE}, {VEC}, s AS (SELECT query_id, doc_id AS chunk_id, round(coalesce(list_cosine_similarity(v, {QUERY_VECTOR}), 0.1), 9) AS emb FROM q CROSS JOIN documents LEFT JOIN v ON vec_id = doc_id)"""


def embedding_scores(spark, sf):
    """``chunk_id, emb``: cosine to the constant query vector, 0.1 without a vector."""
    return chunk_vectors(spark, sf).select("chunk_id", F.round(F.coalesce(V.cosine(F.col("v"), constant()), F.lit(0.1)), 9).alias("emb"))


def embedding_pairs(spark, sf):
    """``query_id, chunk_id, emb``: one score for all queries, so nothing lexical is worked out."""
    return asked(spark, sf).select("query_id").crossJoin(embedding_scores(spark, sf))


ALL = ["emb", "qlm", "mrf", "kw"]


def retrieval(spark, sf, more=None):
    """The benchmark's passages against all documents, with ``emb`` and ``has`` (a vector exists) of each; ``more(query_id, numbers...)`` goes with the queries."""
    queries = asked(spark, sf).select("query_id", tokenize(F.col("text")).alias("tokens"), F.size(whitespace_words(F.col("text"))).alias("n_words"))
    queries = queries if more is None else queries.join(more, "query_id")
    docs = spread(texts(spark, sf)).select("chunk_id", tokenize(F.col("text")).alias("tokens"), F.size(whitespace_words(F.col("text"))).alias("n_words"))
    cosines = vectors(spark, sf).select(F.col("vec_id").alias("chunk_id"), F.round(F.coalesce(V.cosine(F.col("v"), constant()), F.lit(0.1)), 9).alias("emb"), F.col("v").isNotNull().cast("int").alias("has"))
    return R.Retrieval(queries, docs.join(cosines, "chunk_id", "left").fillna({"emb": 0.1, "has": 0}))


def signals(spark, sf, mixture=None, names=ALL):
    """``query_id, chunk_id, names..., n``: raw signals of every passage and document, made where the documents are, stored.

    ``mixture`` makes ``mrf`` of the features (the usual mixture unless given).
    """
    return stored(retrieval(spark, sf).signals(list(names), mixture or R.plain_mixture()), "signals")


def signals_cte(*windows: int) -> str:
    return f"""{mrf_cte(*windows)}, {VEC}, {KEYWORDS},
    emb AS (SELECT doc_id AS chunk_id, source AS doc, round(coalesce(list_cosine_similarity(v, {QUERY_VECTOR}), 0.1), 9) AS emb FROM documents LEFT JOIN v ON vec_id = doc_id),
    qlm AS (SELECT p.query_id, p.chunk_id, round(coalesce(sum(CASE WHEN dl > 0 THEN qn * ln(greatest((coalesce(tf, 0) + 1500.0 * cf / total) / (dl + 1500.0), 1e-6)) END), 0.0), 9) AS qlm
        FROM pairs p LEFT JOIN (SELECT * FROM qt JOIN cf USING (term) CROSS JOIN tot) t ON p.query_id = t.query_id LEFT JOIN tf ON tf.chunk_id = p.chunk_id AND tf.term = t.term GROUP BY ALL),
    s AS MATERIALIZED (SELECT query_id, chunk_id, n, doc, emb, qlm, round(0.8 * u + 0.1 * o + 0.1 * x, 9) AS mrf, round(0.4 * matches + 0.4 * "unique" + 20 * frequency, 9) AS kw
        FROM feat JOIN emb USING (chunk_id) JOIN qlm USING (query_id, chunk_id) JOIN keywords USING (query_id, chunk_id) WHERE feat.w = 8)"""


SIGNALS = signals_cte(8)


def _z(c: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    return f"CASE WHEN round(stddev_pop({c}) {w}, 12) = 0 THEN 0.0 ELSE greatest(-3.0, least(3.0, ({c} - avg({c}) {w}) / stddev_pop({c}) {w})) END"


def _robust(c: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    p25, p75 = f"quantile_cont({c}, 0.25) {w}", f"quantile_cont({c}, 0.75) {w}"
    return f"""CASE WHEN {p75} = {p25} THEN CASE WHEN max({c}) {w} = min({c}) {w} THEN 0.0 ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END
        ELSE greatest(-2.0, least(2.0, ({c} - {p25}) / ({p75} - {p25}))) END"""


def _range(c: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    return f"CASE WHEN max({c}) {w} = min({c}) {w} THEN 0.5 ELSE 0.3 + ({c} - min({c}) {w}) * (0.7 - 0.3) / (max({c}) {w} - min({c}) {w}) END"


def one(spark, sf, name):
    return signals(spark, sf, names=[name]).select("query_id", "chunk_id", F.col(name).alias("score"))


@query("normalize_zscore", f"WITH {SIGNALS} SELECT query_id, chunk_id, {_z('mrf')} AS score FROM s", "score")
def normalize_zscore(spark, sf):
    return N.zscore(one(spark, sf, "mrf"), ["score"], BY)


@query("normalize_minmax", f"WITH {SIGNALS} SELECT query_id, chunk_id, CASE WHEN max(qlm) OVER w = min(qlm) OVER w THEN 0.5 ELSE (qlm - min(qlm) OVER w) / (max(qlm) OVER w - min(qlm) OVER w) END AS score FROM s WINDOW w AS (PARTITION BY query_id)", "score")
def normalize_minmax(spark, sf):
    return N.minmax(one(spark, sf, "qlm"), ["score"], BY)


@query("normalize_none", f"WITH {SIGNALS} SELECT query_id, chunk_id, qlm AS score FROM s", "score")
def normalize_none(spark, sf):
    return N.normalize_all(one(spark, sf, "qlm"), ["score"], BY, "none")


@query("normalize_all", f"WITH {SIGNALS} SELECT query_id, chunk_id, {', '.join(f'{_z(c)} AS {c}' for c in ('emb', 'qlm', 'mrf', 'kw'))} FROM s", "emb qlm mrf kw")
def normalize_all(spark, sf):
    return N.normalize_all(signals(spark, sf), ["emb", "qlm", "mrf", "kw"], BY).select("query_id", "chunk_id", "emb", "qlm", "mrf", "kw")


@query("normalize_robust", f"WITH {SIGNALS} SELECT query_id, chunk_id, {_robust('mrf')} AS score FROM s", "score")
def normalize_robust(spark, sf):
    return N.robust(one(spark, sf, "mrf"), ["score"], BY)


@query("scale_to_range", f"WITH {SIGNALS} SELECT query_id, chunk_id, {_range('qlm')} AS score FROM s", "score")
def scale_to_range(spark, sf):
    return N.scale_to_range(one(spark, sf, "qlm"), ["score"], BY)


_INTELLIGENT = f"{SIGNALS}, r AS (SELECT query_id, chunk_id, {_robust('mrf')} AS rm, {_robust('emb')} AS re FROM s), i AS (SELECT query_id, chunk_id, {_range('rm')} AS mrf, {_range('re')} AS emb FROM r)"


@query("normalize_intelligent", f"WITH {_INTELLIGENT} SELECT * FROM i", "mrf emb")
def normalize_intelligent(spark, sf):
    return N.normalize_intelligent(signals(spark, sf, names=["mrf", "emb"]).select("query_id", "chunk_id", "mrf", "emb"), ["mrf", "emb"], BY)


_ROW = """m AS (SELECT *, (emb + qlm + mrf + kw) / 4 AS mean FROM s), d AS (SELECT *, sqrt(((emb - mean) ** 2 + (qlm - mean) ** 2 + (mrf - mean) ** 2 + (kw - mean) ** 2) / 4) AS sd FROM m),
    rz AS (SELECT query_id, chunk_id, """ + ", ".join(f"CASE WHEN round(sd, 12) = 0 THEN 0.0 ELSE greatest(-3.0, least(3.0, ({c} - mean) / sd)) END AS {c}" for c in ("emb", "qlm", "mrf", "kw")) + " FROM d)"


@query("row_zscore", f"WITH {SIGNALS}, {_ROW} SELECT * FROM rz", "emb qlm mrf kw")
def row_zscore(spark, sf):
    return N.row_zscore(signals(spark, sf).select("query_id", "chunk_id", "emb", "qlm", "mrf", "kw"), ["emb", "qlm", "mrf", "kw"])


@query("combine_scores", f"WITH {SIGNALS} SELECT query_id, chunk_id, 0.45 * emb + 0.2 * qlm + 0.1 * mrf + 0.25 * kw AS score FROM s", "score")
def combine_scores(spark, sf):
    return signals(spark, sf).select("query_id", "chunk_id", N.combine({"emb": 0.45, "qlm": 0.2, "mrf": 0.1, "kw": 0.25}).alias("score"))


@query("make_scored", f"WITH {SIGNALS} SELECT query_id, chunk_id, doc, emb AS embedding_score, qlm AS qlm_score, mrf AS mrf_score FROM s", "embedding_score qlm_score mrf_score")
def make_scored(spark, sf):
    s = signals(spark, sf).join(chunks(spark, sf).select("chunk_id", "doc"), "chunk_id")
    return s.select("query_id", "chunk_id", "doc", F.col("emb").alias("embedding_score"), F.col("qlm").alias("qlm_score"), F.col("mrf").alias("mrf_score"))


@query("query_chunk_cross", f"WITH {CTE} SELECT query_id, count(*) AS n, sum(chunk_id)::BIGINT AS total FROM pairs GROUP BY ALL")
def query_chunk_cross(spark, sf):
    return index(spark, sf).pairs().groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_id").alias("total"))


@query("score_lookup_outer", f"WITH {CTE} SELECT query_id, chunk_id, coalesce(hit, 0) AS hit FROM pairs LEFT JOIN (SELECT query_id, chunk_id, sum(qn)::BIGINT AS hit FROM qt JOIN tf USING (term) GROUP BY ALL) USING (query_id, chunk_id)")
def score_lookup_outer(spark, sf):
    i = index(spark, sf)
    hits = i.matches().groupBy("query_id", "chunk_id").agg(F.sum("qn").alias("hit"))
    return i.pairs().join(hits, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.coalesce("hit", F.lit(0)).alias("hit"))


def ranked_sql(score: str, source: str, k: int) -> str:
    return f"SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, {score} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 6) DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {k}"


@query("rank_by_score", f"WITH {SIGNALS} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(qlm, 6) DESC, chunk_id) AS rank FROM s")
def rank_by_score(spark, sf):
    return ranking.rank_all(signals(spark, sf, names=["qlm"]), BY, "qlm").select("query_id", "chunk_id", "rank")


@query("argsort_rank", f"WITH {EMBEDDINGS} SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(emb, 6) DESC, chunk_id) AS rank FROM s")
def argsort_rank(spark, sf):
    return ranking.rank_all(embedding_pairs(spark, sf), BY, "emb").select("query_id", "chunk_id", "rank")


@query("top_k", f"WITH {SIGNALS} {ranked_sql('qlm', 's', 10)}", "score")
def top_k(spark, sf):
    return found(retrieval(spark, sf).top(10, only("qlm"), ["qlm"], rising="qlm"))


def only(name):
    return lambda signals, queries: signals[name]


def found(df):
    return df.select("query_id", "chunk_id", "score", "rank")


def blended(spark, sf, weigh, mixture=None, more=None, k=5):
    """The k best by two z-scored signals, mrf and emb; ``weigh(queries)`` gives the weights of both, by query or for all.

    Means and deviations take a pass of their own; with them a score never falls as mrf grows, so the second pass can leave out most documents.
    """
    r, mixture = retrieval(spark, sf, more), mixture or R.plain_mixture()
    m = r.moments("mrf", mixture)
    mean, sd = r.stored_docs.agg(F.avg("emb"), F.stddev_pop("emb")).first()

    def z(x, mean, sd):
        flat = np.round(sd, 12) == 0
        return np.where(flat, 0.0, np.clip((x - mean) / np.where(flat, 1.0, sd), -3, 3))

    def score(signals, queries):
        own = np.array([m[i] for i in queries.ids]).reshape(-1, 2)
        wm, we = (np.reshape(w, (-1, 1)) for w in weigh(queries))
        return wm * z(signals["mrf"], own[:, :1], own[:, 1:]) + we * z(signals["emb"], mean or 0.0, sd or 0.0)

    return found(r.top(k, score, ["mrf", "emb"], mixture, rising="mrf"))


def _top(df, score, k):
    return ranking.top_k(df.select("query_id", "chunk_id", score.alias("score")), k, BY).select("query_id", "chunk_id", "score", "rank")


@query("adaptive_weights", f"WITH {CTE} SELECT query_id, CASE WHEN n <= 3 THEN 0.4 WHEN n <= 6 THEN 0.5 WHEN n <= 10 THEN 0.7 ELSE 0.8 END AS mrf_weight, CASE WHEN n <= 3 THEN 0.6 WHEN n <= 6 THEN 0.5 WHEN n <= 10 THEN 0.3 ELSE 0.2 END AS emb_weight FROM ql", "mrf_weight emb_weight")
def adaptive_weights(spark, sf):
    m, e = N.adaptive_weights(F.col("n"))
    return index(spark, sf).query_length.select("query_id", m.alias("mrf_weight"), e.alias("emb_weight"))


@query("search_embeddings", f"WITH {EMBEDDINGS} {ranked_sql('emb', 's', 5)}", "score")
def search_embeddings(spark, sf):
    return _top(embedding_pairs(spark, sf), F.col("emb"), 5)


@query("baseline_ranking", f"WITH {EMBEDDINGS} {ranked_sql('emb', 's', 30)}", "score")
def baseline_ranking(spark, sf):
    return _top(embedding_pairs(spark, sf), F.col("emb"), 30)


@query("search_single_model", f"WITH {EMBEDDINGS} {ranked_sql('100 * emb', 's', 5)}", "score")
def search_single_model(spark, sf):
    return _top(embedding_pairs(spark, sf), 100 * F.col("emb"), 5)


@query("search_mrf", f"WITH {SIGNALS} {ranked_sql('mrf', 's', 5)}", "score")
def search_mrf(spark, sf):
    return found(retrieval(spark, sf).top(5, only("mrf"), ["mrf"], rising="mrf"))


@query("search_keywords", f"WITH {SIGNALS} {ranked_sql('kw', 's', 5)}", "score")
def search_keywords(spark, sf):
    return found(retrieval(spark, sf).top(5, only("kw"), ["kw"]))


_ZME = f"z AS (SELECT query_id, chunk_id, n, {_z('mrf')} AS zm, {_z('emb')} AS ze FROM s)"


SIX_FOUR = lambda queries: (0.6, 0.4)


@query("search_mrf_emb", f"WITH {SIGNALS}, {_ZME} {ranked_sql('(0.6 * zm + 0.4 * ze)', 'z', 5)}", "score")
def search_mrf_emb(spark, sf):
    return blended(spark, sf, SIX_FOUR)


_AW = "(CASE WHEN n <= 3 THEN 0.4 WHEN n <= 6 THEN 0.5 WHEN n <= 10 THEN 0.7 ELSE 0.8 END * zm + CASE WHEN n <= 3 THEN 0.6 WHEN n <= 6 THEN 0.5 WHEN n <= 10 THEN 0.3 ELSE 0.2 END * ze)"


@query("search_mrf_emb_adaptive", f"WITH {SIGNALS}, {_ZME} {ranked_sql(_AW, 'z', 5)}", "score")
def search_mrf_emb_adaptive(spark, sf):
    m, e = N.adaptive_weights(F.col("n"))
    lengths = asked(spark, sf).select("query_id", F.size(tokenize(F.col("text"))).alias("n"))
    return blended(spark, sf, lambda queries: (queries.extra["wm"], queries.extra["we"]), more=lengths.select("query_id", m.alias("wm"), e.alias("we")))


def _other_mrf(name: str, cte: str, *windows: int) -> str:
    return f"{signals_cte(*windows)}, {cte}, s2 AS (SELECT query_id, chunk_id, n, emb, round(score, 9) AS mrf FROM s JOIN {name} USING (query_id, chunk_id)), z AS (SELECT query_id, chunk_id, n, {_z('mrf')} AS zm, {_z('emb')} AS ze FROM s2)"


@query("search_mrf_emb_windows", f"WITH {_other_mrf('optimized', OPTIMIZED, 3, 4, 5, 6, 7, 8, 9)} {ranked_sql('(0.6 * zm + 0.4 * ze)', 'z', 5)}", "score")
def search_mrf_emb_windows(spark, sf):
    return blended(spark, sf, SIX_FOUR, R.optimized_mixture)


@query("search_mrf_emb_ensemble", f"WITH {_other_mrf('ensemble', ENSEMBLE, 4, 6, 8, 10, 12)} {ranked_sql('(0.6 * zm + 0.4 * ze)', 'z', 5)}", "score")
def search_mrf_emb_ensemble(spark, sf):
    return blended(spark, sf, SIX_FOUR, R.ensemble_mixture)


@query("search_mrf_emb_robust", f"WITH {_INTELLIGENT} {ranked_sql('(0.6 * mrf + 0.4 * emb)', 'i', 5)}", "score")
def search_mrf_emb_robust(spark, sf):
    return _top(N.normalize_intelligent(signals(spark, sf, names=["mrf", "emb"]).select("query_id", "chunk_id", "mrf", "emb"), ["mrf", "emb"], BY), N.combine({"mrf": 0.6, "emb": 0.4}), 5)


_HYBRID = f"{SIGNALS}, h AS (SELECT query_id, chunk_id, emb, qlm, kw, round(0.7 * u + 0.2 * o + 0.1 * x, 9) AS mrf FROM s JOIN feat USING (query_id, chunk_id)), {_ROW.replace('FROM s)', 'FROM h)')}"


@query("search_lexical_hybrid", f"WITH {_HYBRID} {ranked_sql('(0.4 * kw + 0.3 * emb + 0.2 * mrf + 0.1 * qlm)', 'rz', 5)}", "score")
def search_lexical_hybrid(spark, sf):
    """Keywords .4, embedding .3, dependence model .2 (its features at .7, .2, .1) and likelihood .1, each z-scored within its row."""

    def score(signals, queries):
        rows = np.stack([signals[c] for c in ALL])
        mean, sd = rows.mean(0), rows.std(0)
        flat = np.round(sd, 12) == 0
        e, q, m, w = np.where(flat, 0.0, np.clip((rows - mean) / np.where(flat, 1.0, sd), -3, 3))
        return 0.4 * w + 0.3 * e + 0.2 * m + 0.1 * q

    return found(retrieval(spark, sf).top(5, score, ALL, R.plain_mixture(0.7, 0.2, 0.1)))


@query("doc_max_pool", f"WITH {SIGNALS} SELECT query_id, doc, score, chunk_id FROM (SELECT query_id, doc, qlm AS score, chunk_id, row_number() OVER (PARTITION BY query_id, doc ORDER BY round(qlm, 6) DESC, chunk_id) AS r FROM s) WHERE r = 1", "score")
def doc_max_pool(spark, sf):
    s = signals(spark, sf).join(chunks(spark, sf).select("chunk_id", "doc"), "chunk_id").withColumnRenamed("qlm", "score")
    return ranking.doc_max_pool(s, BY)


@query("z_events", "SELECT event_id, CASE WHEN round(stddev_pop(value) OVER w, 12) = 0 THEN 0.0 ELSE greatest(-3.0, least(3.0, (value - avg(value) OVER w) / stddev_pop(value) OVER w)) END AS z FROM events WINDOW w AS (PARTITION BY event_type)", "z")
def z_events(spark, sf):
    return N.zscore(table(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("z")), ["z"], ["event_type"]).select("event_id", "z")
