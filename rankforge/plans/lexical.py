"""Queries of the lexical scorers: every benchmark passage against every document."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokenize, whitespace_words
from ..operators import lexical as L
from ..operators import retrieval as R
from ..operators import subwords as S
from .common import CTE, asked, index, mrf_cte, spread, texts
from .registry import query

_DIRICHLET = f"""
    WITH {CTE} SELECT p.query_id, p.chunk_id,
        coalesce(sum(CASE WHEN dl > 0 THEN qn * ln(greatest((coalesce(tf, 0) + 1500.0 * cf / total) / (dl + 1500.0), 1e-6)) END), 0.0) AS score
    FROM pairs p LEFT JOIN (SELECT * FROM qt JOIN cf USING (term) CROSS JOIN tot) t ON p.query_id = t.query_id
    LEFT JOIN tf ON tf.chunk_id = p.chunk_id AND tf.term = t.term GROUP BY ALL
"""
_JM = f"""
    WITH {CTE} SELECT p.query_id, p.chunk_id,
        coalesce(sum(CASE WHEN dl > 0 THEN qn * ln(greatest(0.5 * coalesce(tf, 0) / dl + 0.5 * cf / total, 1e-6)) END), 0.0) AS score
    FROM pairs p LEFT JOIN (SELECT * FROM qt JOIN cf USING (term) CROSS JOIN tot) t ON p.query_id = t.query_id
    LEFT JOIN tf ON tf.chunk_id = p.chunk_id AND tf.term = t.term GROUP BY ALL
"""


def dependence(spark, sf, windows, position=False):
    """Features of every passage and document, made where the documents are; nothing of a pair is exchanged."""
    sized = lambda df, key: df.select(key, tokenize(F.col("text")).alias("tokens"), F.size(whitespace_words(F.col("text"))).alias("n_words"))
    return R.Retrieval(sized(asked(spark, sf), "query_id"), sized(spread(texts(spark, sf)), "chunk_id")).features(windows, position)


@query("qlm_dirichlet", _DIRICHLET, "score")
def qlm_dirichlet(spark, sf):
    return L.qlm_dirichlet(index(spark, sf))


@query("qlm_jelinek_mercer", _JM, "score")
def qlm_jelinek_mercer(spark, sf):
    return L.qlm_jelinek_mercer(index(spark, sf))


@query("qlm_score", _JM, "score")
def qlm_score(spark, sf):
    return L.qlm_score(index(spark, sf), "jelinek_mercer", lam=0.5)


@query("query_term_weights", f"WITH {CTE} SELECT query_id, term, qn, greatest(0.0, ln((n_chunks + 0.5) / 0.5)) AS weight FROM qt CROSS JOIN tot", "weight")
def query_term_weights(spark, sf):
    return L.query_term_weights(index(spark, sf))


@query(
    "qlm_weighted",
    f"""WITH {CTE} SELECT p.query_id, p.chunk_id,
        coalesce(sum(CASE WHEN dl > 0 THEN ln((n_chunks + 0.5) / 0.5) * ln((coalesce(tf, 0) + 1500.0 * cf / total) / (dl + 1500.0)) END), 0.0) AS score
    FROM pairs p LEFT JOIN (SELECT * FROM qt JOIN cf USING (term) CROSS JOIN tot) t ON p.query_id = t.query_id
    LEFT JOIN tf ON tf.chunk_id = p.chunk_id AND tf.term = t.term GROUP BY ALL""",
    "score",
)
def qlm_weighted(spark, sf):
    return L.qlm_weighted(index(spark, sf))


@query(
    "bm25_term",
    f"""WITH {CTE}, m AS (
        SELECT query_id, chunk_id, sum(CASE WHEN n_chunks - df + 0.5 > 0 THEN ln((n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl)) END) AS score
        FROM qt JOIN cf USING (term) JOIN tf USING (term) JOIN dl USING (chunk_id) CROSS JOIN tot GROUP BY ALL)
    SELECT query_id, chunk_id, coalesce(score, 0.0) AS score FROM pairs LEFT JOIN m USING (query_id, chunk_id)""",
    "score",
)
def bm25_term(spark, sf):
    return L.bm25(index(spark, sf))


@query("mrf_unigram", f"WITH {mrf_cte(8)} SELECT query_id, chunk_id, u AS score FROM unigram", "score")
def mrf_unigram(spark, sf):
    return L.mrf_unigram(index(spark, sf))


@query("mrf_ordered", f"WITH {mrf_cte(8)} SELECT query_id, chunk_id, o AS score FROM ordered", "score")
def mrf_ordered(spark, sf):
    return dependence(spark, sf, (1,)).select("query_id", "chunk_id", F.col("ordered").alias("score"))


@query("mrf_unordered", f"WITH {mrf_cte(8)} SELECT query_id, chunk_id, x AS score FROM feat WHERE w = 8", "score")
def mrf_unordered(spark, sf):
    return dependence(spark, sf, (8,)).select("query_id", "chunk_id", F.col("w8").alias("score"))


@query("mrf_sd", f"WITH {mrf_cte(8)} SELECT query_id, chunk_id, 0.8 * u + 0.1 * o + 0.1 * x AS score FROM feat WHERE w = 8", "score")
def mrf_sd(spark, sf):
    return dependence(spark, sf, (8,)).select("query_id", "chunk_id", L.mixed().alias("score"))


@query("mrf_windows", f"WITH {mrf_cte(4, 8, 16, 32)} SELECT query_id, chunk_id, x AS score, w::BIGINT AS \"window\" FROM feat", "score")
def mrf_windows(spark, sf):
    return L.by_window(dependence(spark, sf, (4, 8, 16, 32)), (4, 8, 16, 32))


_POSITION = """position AS (
        SELECT query_id, chunk_id, coalesce(h::DOUBLE / n_pairs, 0.0) AS pos FROM pairs LEFT JOIN qbn USING (query_id) LEFT JOIN (
            SELECT query_id, chunk_id, sum(times / (1.0 + gap)) AS h FROM qb JOIN (
                SELECT chunk_id, a, b, gap FROM gaps WHERE a <> b AND gap <= 8 UNION ALL SELECT chunk_id, term, term, 0 FROM tf
            ) g ON g.a = least(qb.a, qb.b) AND g.b = greatest(qb.a, qb.b) GROUP BY ALL) USING (query_id, chunk_id))"""


@query("mrf_position", f"WITH {mrf_cte(8)}, {_POSITION} SELECT query_id, chunk_id, pos AS score FROM position", "score")
def mrf_position(spark, sf):
    return dependence(spark, sf, (1,), position=True).select("query_id", "chunk_id", F.col("position").alias("score"))


_ADAPTIVE = """adapted AS (
        SELECT query_id, chunk_id, wu / (wu + wo + wx) AS wu, wo / (wu + wo + wx) AS wo, wx / (wu + wo + wx) AS wx FROM (
            SELECT query_id, chunk_id, CASE n WHEN 1 THEN 1.0 WHEN 2 THEN 0.3 ELSE 0.8 END * CASE WHEN cov < 0.5 THEN 1.5 ELSE 1.0 END AS wu,
                   CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 0.6 ELSE 0.1 END * CASE WHEN cov < 0.5 THEN 0.5 ELSE 1.0 END AS wo,
                   CASE n WHEN 1 THEN 0.0 WHEN 2 THEN 0.1 ELSE 0.1 END * CASE WHEN cov < 0.5 THEN 0.5 ELSE 1.0 END AS wx
            FROM unigram))"""


@query("mrf_adaptive_weights", f"WITH {mrf_cte(8)}, {_ADAPTIVE} SELECT query_id, chunk_id, wu AS w_unigram, wo AS w_ordered, wx AS w_unordered FROM adapted", "w_unigram w_ordered w_unordered")
def mrf_adaptive_weights(spark, sf):
    i = index(spark, sf)
    c = L.mrf_coverage(i)
    u, o, w = L.adaptive_feature_weights(F.col("n"), F.col("score"))
    return c.select("query_id", "chunk_id", u.alias("w_unigram"), o.alias("w_ordered"), w.alias("w_unordered"))


@query(
    "mrf_enhanced",
    f"""WITH {mrf_cte(8)}, {_POSITION}, {_ADAPTIVE} SELECT query_id, chunk_id, wu * u + wo * o + wx * x + 0.1 * pos AS score
    FROM (SELECT * FROM feat WHERE w = 8) JOIN adapted USING (query_id, chunk_id) JOIN position USING (query_id, chunk_id)""",
    "score",
)
def mrf_enhanced(spark, sf):
    return dependence(spark, sf, (8,), position=True).select("query_id", "chunk_id", L.enhanced().alias("score"))


OPTIMIZED = """optimized AS (
        SELECT query_id, chunk_id, sum(c * (0.8 * u + 0.1 * o + 0.1 * x)) AS score FROM feat JOIN (
            VALUES (0, 3, 0.3), (0, 4, 0.5), (0, 5, 0.2), (1, 5, 0.3), (1, 6, 0.5), (1, 7, 0.2), (2, 7, 0.3), (2, 8, 0.5), (2, 9, 0.2)) v(band, w, c)
        ON feat.w = v.w AND v.band = CASE WHEN n <= 3 THEN 0 WHEN n <= 6 THEN 1 ELSE 2 END GROUP BY ALL)"""
ENSEMBLE = """qw AS (SELECT item_id AS query_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n_words FROM benchmark),
    ensemble AS (
        SELECT query_id, chunk_id, sum(c * (wu * u + wo * o + wx * x)) AS score FROM feat JOIN qw USING (query_id) JOIN (
            VALUES (8, 0.8, 0.1, 0.1, 0, 0.4), (6, 0.3, 0.6, 0.1, 0, 0.3), (10, 0.2, 0.1, 0.7, 0, 0.1), (4, 0.5, 0.3, 0.2, 0, 0.15), (12, 0.4, 0.3, 0.3, 0, 0.05),
                   (8, 0.8, 0.1, 0.1, 1, 0.25), (6, 0.3, 0.6, 0.1, 1, 0.25), (10, 0.2, 0.1, 0.7, 1, 0.2), (4, 0.5, 0.3, 0.2, 1, 0.15), (12, 0.4, 0.3, 0.3, 1, 0.15),
                   (8, 0.8, 0.1, 0.1, 2, 0.15), (6, 0.3, 0.6, 0.1, 2, 0.2), (10, 0.2, 0.1, 0.7, 2, 0.3), (4, 0.5, 0.3, 0.2, 2, 0.2), (12, 0.4, 0.3, 0.3, 2, 0.15)) v(w, wu, wo, wx, band, c)
        ON feat.w = v.w AND v.band = CASE WHEN n_words <= 3 THEN 0 WHEN n_words <= 6 THEN 1 ELSE 2 END GROUP BY ALL)"""


@query("mrf_optimized_windows", f"WITH {mrf_cte(3, 4, 5, 6, 7, 8, 9)}, {OPTIMIZED} SELECT * FROM optimized", "score")
def mrf_optimized_windows(spark, sf):
    return dependence(spark, sf, L.OPTIMIZED_SIZES).select("query_id", "chunk_id", L.optimized().alias("score"))


def query_words(spark, sf):
    return asked(spark, sf).select("query_id", F.size(whitespace_words(F.col("text"))).alias("n_words"))


def chunk_words(spark, sf):
    return texts(spark, sf).select("chunk_id", F.size(whitespace_words(F.col("text"))).alias("n_words"))


@query("mrf_ensemble", f"WITH {mrf_cte(4, 6, 8, 10, 12)}, {ENSEMBLE} SELECT * FROM ensemble", "score")
def mrf_ensemble(spark, sf):
    return dependence(spark, sf, L.ENSEMBLE_SIZES).select("query_id", "chunk_id", L.ensemble().alias("score"))


KEYWORDS = r"""cw AS (SELECT doc_id AS chunk_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n_words FROM documents),
    kw AS (SELECT * FROM qt WHERE length(term) >= 3), kn AS (SELECT query_id, sum(qn)::BIGINT AS n_wanted FROM kw GROUP BY ALL),
    km AS (SELECT query_id, chunk_id, sum(tf)::BIGINT AS matches, count(*) AS "unique", avg(tf::DOUBLE / n_words) AS frequency FROM kw JOIN tf USING (term) JOIN cw USING (chunk_id) GROUP BY ALL),
    keywords AS (SELECT query_id, chunk_id, coalesce(matches, 0) AS matches, coalesce("unique", 0) AS "unique", coalesce(frequency, 0.0) AS frequency, coalesce("unique"::DOUBLE / n_wanted, 0.0) AS coverage
           FROM pairs LEFT JOIN kn USING (query_id) LEFT JOIN km USING (query_id, chunk_id))"""


@query("keyword_match", f"WITH {CTE}, {KEYWORDS} SELECT * FROM keywords", "frequency coverage")
def keyword_match(spark, sf):
    return L.keyword_match(index(spark, sf), chunk_words(spark, sf))


@query("keyword_score", f'WITH {CTE}, {KEYWORDS} SELECT query_id, chunk_id, 0.4 * matches + 0.4 * "unique" + 20 * frequency AS score FROM keywords', "score")
def keyword_score(spark, sf):
    return L.keyword_score(index(spark, sf), chunk_words(spark, sf))


_RUNS = r"""r AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS n_words, regexp_extract_all(lower(text), '([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)') AS runs FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, n_words, unnest(runs) AS word, unnest(range(1, len(runs) + 1)) AS i FROM r),
    p AS (SELECT doc_id, n_words, word, sum(length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word) AS place FROM u),
    a AS (SELECT DISTINCT query_id, term AS word FROM (SELECT query_id, unnest(toks) AS term FROM q WHERE query_id % 50 = 0) WHERE length(term) > 2)"""


@query(
    "keyword_places",
    f"""WITH {CTE}, {_RUNS} SELECT query_id, doc_id AS chunk_id, word, count(*) AS count, count(*)::DOUBLE / n_words AS frequency, array_to_string(list(place::BIGINT ORDER BY place), ' ') AS places
    FROM p JOIN a USING (word) GROUP BY query_id, doc_id, word, n_words""",
    "frequency",
)
def keyword_places(spark, sf):
    """Where each word of a query stands in each text, for every query whose id is divisible by 50 against all texts."""
    few = asked(spark, sf).where(F.col("query_id") % 50 == 0)
    words = few.select(F.explode(tokenize(F.col("text"))).alias("word")).where(F.length("word") > 2)
    made = S.keyword_places(few, S.word_places(spread(texts(spark, sf)), words), tokenize(F.col("text")))
    return made.withColumn("places", F.array_join(F.col("places").cast("array<string>"), " "))
