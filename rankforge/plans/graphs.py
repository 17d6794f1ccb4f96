"""Queries of chunk graphs, PageRank and the full re-ranking.

Each query's candidates are its best 100 documents by query likelihood (k'); its seeds are the best three. PageRank goes on to a
difference of 1e-6, at most 100 steps; re-ranking returns the best 30. The oracles iterate in the same way, in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import evaluate as E
from ..operators import fusion as N
from ..operators import graph as G
from ..operators import ranking
from ..operators.keep import stored
from .common import asked, chunk_vectors, placed, table
from .fusion import SIGNALS, _z, only, retrieval
from .registry import query

#: The reference's candidates, seeds and results of a query.
K_PRIME, SEEDS, K = 100, 3, 30


def nodes(spark, sf, k_prime=K_PRIME):
    """``query_id, chunk_id, doc, position, embedding, emb, qlm, mrf, rank``, stored: the graph, its seeds and the scores all start from them."""
    best = stored(retrieval(spark, sf).top(k_prime, only("qlm"), ["qlm"], rising="qlm", carry=["emb", "qlm", "mrf"]).drop("score"), "best")
    return stored(best.join(placed(spark, sf), "chunk_id").join(chunk_vectors(spark, sf).withColumnRenamed("v", "embedding"), "chunk_id"), "nodes")


def links(spark, sf):
    """A deterministic stand-in for links: each document to the one seven ids on, where there is one."""
    d = table(spark, sf, "documents").select("doc_id")
    return d.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 7).alias("dst")).join(d.select(F.col("doc_id").alias("dst")), "dst", "left_semi").select("src", "dst")


def edges(spark, sf, n=None):
    return G.build_graph(nodes(spark, sf) if n is None else n, links(spark, sf))


GRAPH = f"""{SIGNALS},
    node AS MATERIALIZED (SELECT query_id, chunk_id, doc, position, v AS embedding, emb, qlm, mrf, rank FROM (SELECT query_id, chunk_id, emb, qlm, mrf, row_number() OVER (PARTITION BY query_id ORDER BY round(qlm, 6) DESC, chunk_id) AS rank FROM s)
        JOIN (SELECT chunk_id, doc, position FROM c) USING (chunk_id) LEFT JOIN v ON v.vec_id = chunk_id WHERE rank <= {K_PRIME}),
    link AS (SELECT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 7),
    half AS MATERIALIZED (SELECT * FROM (SELECT a.query_id, a.chunk_id AS src, b.chunk_id AS dst, round(0.6 * coalesce(list_cosine_similarity(a.embedding, b.embedding), 0.0)
            + 0.25 * CASE WHEN a.doc = b.doc THEN exp(-abs(a.position - b.position) / 5.0) ELSE 0.0 END
            + 0.15 * (SELECT count(*) FROM link WHERE link.src = a.chunk_id AND link.dst = b.chunk_id), 9) AS weight
        FROM node a JOIN node b ON a.query_id = b.query_id AND a.chunk_id < b.chunk_id) WHERE weight > 0.01),
    edge AS MATERIALIZED (SELECT * FROM half UNION ALL SELECT query_id, dst, src, weight FROM half)"""


@query("build_graph", f"WITH {GRAPH} SELECT * FROM edge", "weight")
def build_graph(spark, sf):
    return edges(spark, sf)


@query("filter_edge_weight", f"WITH {GRAPH} SELECT query_id, count(*) AS n_edges FROM edge WHERE weight > 0.1 GROUP BY ALL")
def filter_edge_weight(spark, sf):
    return edges(spark, sf).where(F.col("weight") > 0.1).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_edges"))


@query("link_edges", "SELECT a.doc_id AS src, b.doc_id AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 7")
def link_edges(spark, sf):
    return links(spark, sf)


@query("seed_semi_join", f"WITH {GRAPH} SELECT query_id, chunk_id FROM node WHERE rank <= 3")
def seed_semi_join(spark, sf):
    """Seeds that are nodes of their query's graph."""
    n = nodes(spark, sf)
    return n.where(F.col("rank") <= SEEDS).select("query_id", "chunk_id").join(n.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")


@query("graph_enhanced", f"""WITH {GRAPH}, place AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY position, chunk_id) AS rn FROM node),
    beside AS (SELECT a.query_id, a.chunk_id AS src, b.chunk_id AS dst, 0.25 * exp(-abs(a.position - b.position) / 5.0) AS weight FROM place a JOIN place b ON a.query_id = b.query_id AND a.doc = b.doc AND b.rn - a.rn BETWEEN 1 AND 2),
    more AS (SELECT * FROM beside UNION ALL SELECT query_id, dst, src, weight FROM beside)
    SELECT * FROM edge UNION ALL SELECT * FROM more ANTI JOIN edge USING (query_id, src, dst)""", "weight")
def graph_enhanced(spark, sf):
    n = nodes(spark, sf)
    return G.graph_enhanced(n, edges(spark, sf, n))


def _iterated(restart: str, weight: str = "edge") -> str:
    """Power iteration over each query's dense matrix, to 1e-6 or 100 steps; ``pr(query_id, chunk_id, p)``."""
    return f"""start AS MATERIALIZED (SELECT query_id, chunk_id, ({restart})::DOUBLE AS r FROM node),
        mat AS MATERIALIZED (SELECT a.query_id, a.chunk_id, list(coalesce(e.weight, 0.0)::DOUBLE ORDER BY b.chunk_id) AS w FROM node a JOIN node b ON a.query_id = b.query_id
            LEFT JOIN {weight} e ON e.query_id = a.query_id AND e.src = b.chunk_id AND e.dst = a.chunk_id GROUP BY a.query_id, a.chunk_id),
        q0 AS MATERIALIZED (SELECT start.query_id, list(start.chunk_id ORDER BY start.chunk_id) AS ids, list(r ORDER BY start.chunk_id) AS r, list(w ORDER BY start.chunk_id) AS w
            FROM start JOIN mat ON mat.query_id = start.query_id AND mat.chunk_id = start.chunk_id GROUP BY start.query_id),
        it AS (SELECT query_id, 0 AS step, r AS p, 1.0::DOUBLE AS gap FROM q0 UNION ALL
            SELECT query_id, step + 1, new, list_sum(list_transform(list_zip(new, p), lambda x: abs(x[1] - x[2]))) FROM (
                SELECT query_id, step, p, list_transform(u, lambda x: x / list_sum(u)) AS new FROM (
                    SELECT it.query_id, step, p, list_transform(range(1, len(ids) + 1), lambda i: 0.15 * r[i] + 0.85 * list_inner_product(w[i], p)) AS u FROM it JOIN q0 ON q0.query_id = it.query_id WHERE gap >= 1e-6 AND step < 100))),
        pr AS MATERIALIZED (SELECT query_id, unnest(ids) AS chunk_id, unnest(p) AS p FROM (SELECT query_id, arg_max(p, step) AS p FROM it GROUP BY query_id) JOIN q0 USING (query_id))"""


_RESTART = "CASE WHEN rank <= 3 THEN 1.0 / 3 ELSE 0.0 END"


@query("ppr", f"WITH RECURSIVE {GRAPH}, {_iterated(_RESTART)} SELECT query_id, chunk_id, p AS score FROM pr", "score")
def ppr(spark, sf):
    n = nodes(spark, sf)
    return G.ppr(n, edges(spark, sf, n), n.where(F.col("rank") <= SEEDS))


@query("ppr_teleport", f"WITH RECURSIVE {GRAPH}, {_iterated('CASE WHEN rank <= 3 THEN 0.9 / 3 ELSE 0.1 / 97 END')} SELECT query_id, chunk_id, p AS score FROM pr", "score")
def ppr_teleport(spark, sf):
    n = nodes(spark, sf)
    return G.ppr(n, edges(spark, sf, n), n.where(F.col("rank") <= SEEDS), teleport=0.1)


_ROWS = """stoch AS MATERIALIZED (SELECT query_id, src, dst, weight / sum(weight) OVER (PARTITION BY query_id, src) AS weight FROM edge
    UNION ALL SELECT query_id, chunk_id, chunk_id, 1.0 FROM node WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.query_id = node.query_id AND edge.src = node.chunk_id))"""


@query("ppr_stochastic", f"WITH RECURSIVE {GRAPH}, {_ROWS}, {_iterated(_RESTART, 'stoch')} SELECT query_id, chunk_id, p AS score FROM pr", "score")
def ppr_stochastic(spark, sf):
    n = nodes(spark, sf)
    return G.ppr(n, edges(spark, sf, n), n.where(F.col("rank") <= SEEDS), transition="stochastic")


@query("ppr_scores_for_candidates", f"WITH RECURSIVE {GRAPH}, {_iterated(_RESTART)} SELECT query_id, chunk_id, coalesce(p, 0.0) AS score FROM s LEFT JOIN pr USING (query_id, chunk_id)", "score")
def ppr_scores_for_candidates(spark, sf):
    """Every candidate; one outside the graph scores 0."""
    p = ppr_raw(spark, sf)
    every = asked(spark, sf).select("query_id").crossJoin(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id")))
    return every.join(p, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def ppr_raw(spark, sf, n=None):
    n = nodes(spark, sf) if n is None else n
    return G.ppr_of_nodes(n, links(spark, sf), SEEDS)


@query("l1_diff", f"WITH RECURSIVE {GRAPH}, {_iterated(_RESTART)} SELECT query_id, sum(abs(pr.p - start.r)) AS l1 FROM pr JOIN start USING (query_id, chunk_id) GROUP BY ALL", "l1")
def l1_diff(spark, sf):
    n = nodes(spark, sf)
    restart = n.select("query_id", "chunk_id", F.when(F.col("rank") <= SEEDS, 1.0 / SEEDS).otherwise(0.0).alias("score"))
    return G.l1_diff(ppr_raw(spark, sf, n), restart, ["query_id"])


@query("graph_metrics", f"""WITH {GRAPH}, wedge AS (SELECT a.query_id, a.src AS i, count(*) AS w, count(c.src) AS t FROM edge a JOIN edge b ON a.query_id = b.query_id AND a.src = b.src AND a.dst <> b.dst
        LEFT JOIN edge c ON c.query_id = a.query_id AND c.src = a.dst AND c.dst = b.dst GROUP BY ALL)
    SELECT query_id, nodes, coalesce(edges, 0) AS edges, coalesce(edges, 0) / (nodes * (nodes - 1.0)) AS density, clustering FROM (SELECT query_id, count(*) AS nodes, sum(coalesce(t::DOUBLE / w, 0.0)) / count(*) AS clustering
        FROM node LEFT JOIN wedge ON wedge.query_id = node.query_id AND wedge.i = node.chunk_id GROUP BY node.query_id AS query_id) LEFT JOIN (SELECT query_id, count(*) AS edges FROM edge GROUP BY ALL) USING (query_id)""".replace("SELECT query_id, count(*) AS nodes", "SELECT node.query_id, count(*) AS nodes").replace("GROUP BY node.query_id AS query_id", "GROUP BY node.query_id"), "density clustering")
def graph_metrics(spark, sf):
    n = nodes(spark, sf)
    e = edges(spark, sf, n)
    return G.graph_counts(n, e).join(G.clustering(n, e), "query_id")


@query("graph_average_path")
def graph_average_path(spark, sf):
    """Mean shortest path of each connected graph; tests hold it against a search by hand."""
    n = nodes(spark, sf)
    return G.average_path(n, edges(spark, sf, n))


_TOTAL = "(0.45 * ze + 0.25 * zp + 0.2 * zq + 0.1 * zm)"
RERANK = f"""{GRAPH}, {_iterated(_RESTART)},
    raw AS MATERIALIZED (SELECT query_id, chunk_id, emb, round(p, 9) AS ppr, qlm, mrf FROM node JOIN pr USING (query_id, chunk_id)),
    zz AS (SELECT query_id, chunk_id, {_z('emb')} AS ze, {_z('ppr')} AS zp, {_z('qlm')} AS zq, {_z('mrf')} AS zm FROM raw),
    rr AS (SELECT query_id, chunk_id, ze AS embedding_score, zp AS ppr_score, zq AS qlm_score, zm AS mrf_score, {_TOTAL} AS total_score, row_number() OVER (PARTITION BY query_id ORDER BY round({_TOTAL}, 6) DESC, chunk_id) AS rank FROM zz)"""


def reranked(spark, sf):
    """Candidates by 0.45 embedding + 0.25 PageRank + 0.2 query likelihood + 0.1 dependence model, all z-scored."""
    n = nodes(spark, sf)
    raw = n.select("query_id", "chunk_id", "emb", "qlm", "mrf").join(ppr_raw(spark, sf, n).select("query_id", "chunk_id", F.round("score", 9).alias("ppr")), ["query_id", "chunk_id"])
    z = N.normalize_all(raw, ["emb", "ppr", "qlm", "mrf"], ["query_id"])
    z = z.withColumn("total_score", N.combine({"emb": 0.45, "ppr": 0.25, "qlm": 0.2, "mrf": 0.1}))
    named = z.select("query_id", "chunk_id", F.col("emb").alias("embedding_score"), F.col("ppr").alias("ppr_score"), F.col("qlm").alias("qlm_score"), F.col("mrf").alias("mrf_score"), "total_score")
    return ranking.rank_by(named, ["query_id"], "total_score")


_SCORES = "embedding_score ppr_score qlm_score mrf_score total_score"


@query("rerank", f"WITH RECURSIVE {RERANK} SELECT * FROM rr WHERE rank <= {K}", _SCORES)
def rerank(spark, sf):
    return reranked(spark, sf).where(F.col("rank") <= K)


@query("rerank_analysis", f"WITH RECURSIVE {RERANK} SELECT * FROM rr WHERE rank <= 10", _SCORES)
def rerank_analysis(spark, sf):
    return reranked(spark, sf).where(F.col("rank") <= 10)


@query("score_distributions", f"""WITH RECURSIVE {RERANK}, u AS (UNPIVOT (SELECT query_id, {_SCORES.replace(' ', ', ')} FROM rr) ON {_SCORES.replace(' ', ', ')} INTO NAME signal VALUE value)
    SELECT query_id, signal, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.5) AS median FROM u GROUP BY ALL""", "mean std min max median")
def score_distributions(spark, sf):
    return E.score_distributions(reranked(spark, sf), _SCORES.split(), ["query_id"])


_PAIR_NAMES = [(a, b) for i, a in enumerate(_SCORES.split()) for b in _SCORES.split()[i + 1 :]]


@query("component_correlations", f"WITH RECURSIVE {RERANK} SELECT query_id, " + ", ".join(f"CASE WHEN round(stddev_pop({a}) * stddev_pop({b}), 12) = 0 THEN 0.0 ELSE covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END AS {a}__{b}" for a, b in _PAIR_NAMES) + " FROM rr GROUP BY query_id", " ".join(f"{a}__{b}" for a, b in _PAIR_NAMES))
def component_correlations(spark, sf):
    return E.component_correlations(reranked(spark, sf), _SCORES.split(), ["query_id"])
