"""Queries of vector functions and distances over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import blocks, neighbours, pairwise
from ..operators.expand import standard_scale as scaled
from ..operators.keep import stored
from .common import table, vectors
from .registry import query

#: Vectors as lists of doubles.
VEC = "v AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
QUERY_VECTOR = "list_transform(range(64), lambda i: 0.5::DOUBLE)"
_PAIRS = f"""{VEC}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS cosine, list_distance(a.v, b.v) AS euclidean, a.label AS label_a, b.label AS label_b
    FROM v a JOIN v b ON a.vec_id < b.vec_id)"""


def constant(dim: int = 64):
    """The constant query vector that stands in where no query encoder is at hand."""
    return F.array(*[F.lit(0.5)] * dim)


def measured(spark, sf, measure, name, **how) -> DataFrame:
    """``a, b, name``: every fiftieth vector (the stated query set) with every other one."""
    v = vectors(spark, sf).select("vec_id", "v")
    return blocks.every(v.where("vec_id % 50 = 0"), v, measure, name, **how)


_NEXT = f"{VEC}, n AS (SELECT s.vec_id AS a, t.vec_id AS b, s.v AS x, t.v AS y FROM v s JOIN v t ON s.vec_id % 50 = 0 AND s.vec_id <> t.vec_id)"


@query("cosine_similarity", f"WITH {_NEXT} SELECT a, b, list_cosine_similarity(x, y) AS cosine FROM n", "cosine")
def cosine_similarity(spark, sf):
    return measured(spark, sf, blocks.cosine, "cosine")


@query("embedding_score", f"WITH {VEC} SELECT doc_id AS chunk_id, coalesce(list_cosine_similarity(v, {QUERY_VECTOR}), 0.1) AS score FROM documents LEFT JOIN v ON vec_id = doc_id", "score")
def embedding_score(spark, sf):
    """Cosine to the query vector; 0.1 for a chunk without a vector."""
    from .common import chunk_vectors

    return chunk_vectors(spark, sf).select("chunk_id", F.coalesce(V.cosine(F.col("v"), constant()), F.lit(0.1)).alias("score"))


@query("l2_normalize", f"WITH {VEC}, s AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM v) SELECT vec_id, list_sum(list_transform(v, lambda x: x / size)) AS total FROM s", "total")
def l2_normalize(spark, sf):
    return vectors(spark, sf).select("vec_id", F.aggregate(V.l2_normalize(F.col("v")), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("percent_similarity", f"WITH {_NEXT} SELECT a, b, 100 * list_cosine_similarity(x, y) AS percent FROM n", "percent")
def percent_similarity(spark, sf):
    return measured(spark, sf, lambda x, y: 100 * blocks.cosine(x, y), "percent")


@query("wasserstein_1d", f"""WITH {_NEXT}, s AS (SELECT a, b, list_sort(list_transform(x, lambda e: e / list_sum(x))) AS x, list_sort(list_transform(y, lambda e: e / list_sum(y))) AS y FROM n)
    SELECT a, b, list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))) / len(x) AS distance FROM s""", "distance")
def wasserstein_1d(spark, sf):
    return measured(spark, sf, blocks.wasserstein, "distance")


@query("optimal_transport_1d", f"""WITH {_NEXT}, e AS (SELECT a, b, unnest(range(1, 65)) AS i, unnest(x) AS x, unnest(y) AS y FROM n),
    m AS (SELECT a, b, i, abs(x) / sum(abs(x)) OVER (PARTITION BY a, b) - abs(y) / sum(abs(y)) OVER (PARTITION BY a, b) AS gap FROM e),
    c AS (SELECT a, b, sum(gap) OVER (PARTITION BY a, b ORDER BY i) AS run FROM m) SELECT a, b, sum(abs(run)) AS distance FROM c GROUP BY ALL""", "distance")
def optimal_transport_1d(spark, sf):
    return measured(spark, sf, blocks.transport, "distance")


@query("dtw_distance")
def dtw_distance(spark, sf):
    """Dynamic time warping; tested against the plain recurrence."""
    return measured(spark, sf, blocks.warping, "distance", ragged=True)


@query("hybrid_distance_scalar", f"WITH {_NEXT} SELECT a, b, 1 - list_cosine_similarity(x, y) + CASE WHEN list_distance(x, y) > 0 THEN 1 ELSE 0 END AS distance FROM n", "distance")
def hybrid_distance_scalar(spark, sf):
    return measured(spark, sf, blocks.hybrid, "distance")


@query("pairwise_cosine", f"WITH {_PAIRS} SELECT a, count(*) AS n, sum(cosine) AS total, max(cosine) AS most FROM p GROUP BY a", "total most")
def pairwise_cosine(spark, sf):
    """All pairs by blocked matrix products, reduced to a row for each vector inside the blocks."""
    return pairwise.by_smaller(vectors(spark, sf)).select("a", "n", F.col("cosine").alias("total"), F.col("most_cosine").alias("most"))


@query("pairwise_euclidean", f"WITH {_PAIRS} SELECT a, count(*) AS n, sum(euclidean) AS total, max(euclidean) AS most FROM p GROUP BY a", "total most")
def pairwise_euclidean(spark, sf):
    return pairwise.by_smaller(vectors(spark, sf)).select("a", "n", F.col("euclidean").alias("total"), F.col("most_euclidean").alias("most"))


@query("hybrid_distance", f"WITH {_PAIRS} SELECT a, sum(0.6 * (cosine + 1) / 2 + 0.4 * euclidean / (SELECT max(euclidean) FROM p)) AS total FROM p GROUP BY a", "total")
def hybrid_distance(spark, sf):
    """0.6 (cos + 1)/2 + 0.4 d / max d, as the reference adds a similarity to a distance."""
    c = stored(pairwise.by_smaller(vectors(spark, sf)), "pairs")
    most = c.agg(F.max("most_euclidean").alias("most"))
    return c.crossJoin(F.broadcast(most)).select("a", (0.6 * (F.col("cosine") + F.col("n")) / 2 + 0.4 * F.col("euclidean") / F.col("most")).alias("total"))  # one row


_SCALED = f"""{VEC}, ze AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM v), zs AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS sd FROM ze GROUP BY dim),
    zv AS MATERIALIZED (SELECT vec_id, list(CASE WHEN sd = 0 THEN 0 ELSE (x - mean) / sd END ORDER BY dim) AS v FROM ze JOIN zs USING (dim) GROUP BY vec_id),
    zp AS MATERIALIZED (SELECT list_cosine_similarity(a.v, b.v) AS cosine, list_distance(a.v, b.v) AS euclidean, list_cosine_similarity(x.v, y.v) AS o FROM zv a JOIN zv b ON a.vec_id < b.vec_id JOIN v x ON x.vec_id = a.vec_id JOIN v y ON y.vec_id = b.vec_id)"""


@query("separation_stats", f"""WITH {_SCALED} SELECT avg(euclidean) AS mean, min(euclidean) AS least, max(euclidean) AS most, stddev_pop(euclidean) AS std, var_pop(euclidean) / (SELECT var_pop(x) FROM (SELECT unnest(v) AS x FROM zv)) AS variance_ratio, min(euclidean) / avg(euclidean) AS least_mean,
    stddev_pop(euclidean) / avg(euclidean) AS std_mean, avg(cosine) AS mean_cosine, min(euclidean) / (avg(cosine) + 1e-8) AS discrimination, corr(cosine, o) AS correlation FROM zp""", "mean least most std variance_ratio least_mean std_mean mean_cosine discrimination correlation")
def separation_stats(spark, sf):
    """Of the standardised vectors, against the original ones."""
    v = vectors(spark, sf)
    return pairwise.separation(scaled(v), v)


_BOTH = f"{_PAIRS}, d AS (SELECT a AS i, b AS j, euclidean FROM p UNION ALL SELECT b, a, euclidean FROM p)"


@query("min_neighbour_distance", f"WITH {_BOTH} SELECT i AS vec_id, min(euclidean) AS least FROM d GROUP BY i", "least")
def min_neighbour_distance(spark, sf):
    return neighbours.nearest(vectors(spark, sf), 1).select(F.col("a").alias("vec_id"), F.col("value").alias("least"))


@query("neighbours_topk", f"WITH {_BOTH} SELECT i AS vec_id, j AS neighbour, euclidean AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(euclidean, 6), j) AS rank FROM d) WHERE rank <= 5", "distance")
def neighbours_topk(spark, sf):
    n = neighbours.nearest(vectors(spark, sf), 5)
    return n.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour"), F.col("value").alias("distance"), "rank")


@query("silhouette", f"""WITH {_PAIRS}, d AS (SELECT a AS i, label_a AS li, label_b AS lj, euclidean FROM p UNION ALL SELECT b, label_b, label_a, euclidean FROM p),
    m AS (SELECT i, li, lj, avg(euclidean) AS mean FROM d GROUP BY ALL), s AS (SELECT i, max(CASE WHEN li = lj THEN mean END) AS own, min(CASE WHEN li <> lj THEN mean END) AS other FROM m GROUP BY i)
    SELECT avg(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END) AS silhouette, avg(own) AS mean_own, avg(other) AS mean_other FROM s""", "silhouette mean_own mean_other")
def silhouette(spark, sf):
    """Exact mean silhouette of the given labels."""
    return pairwise.silhouette(vectors(spark, sf))


@query("discrimination_quality", f"""WITH {_SCALED}, d AS (SELECT a.vec_id AS i, x.label AS li, y.label AS lj, list_distance(a.v, b.v) AS euclidean FROM zv a JOIN zv b ON a.vec_id <> b.vec_id JOIN v x ON x.vec_id = a.vec_id JOIN v y ON y.vec_id = b.vec_id),
    m AS (SELECT i, li, lj, avg(euclidean) AS mean FROM d GROUP BY ALL), s AS (SELECT i, max(CASE WHEN li = lj THEN mean END) AS own, min(CASE WHEN li <> lj THEN mean END) AS other FROM m GROUP BY i)
    SELECT (SELECT avg(least) FROM (SELECT min(euclidean) AS least FROM d GROUP BY i)) AS mean_least, (SELECT var_pop(x) FROM (SELECT unnest(v) AS x FROM zv)) / (SELECT var_pop(x) FROM ze) AS variance_ratio,
    (SELECT avg(CASE WHEN own IS NULL OR other IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END) FROM s) AS silhouette""", "mean_least variance_ratio silhouette")
def discrimination_quality(spark, sf):
    """Of the standardised vectors: mean distance to the nearest, variance against the original's, silhouette of the labels."""
    v = vectors(spark, sf)
    z = stored(scaled(v), "scaled")
    var = lambda d, name: d.select(F.explode("v").alias("x")).agg(F.var_pop("x").alias(name))
    least = neighbours.nearest(z.select("vec_id", "v"), 1).agg(F.avg("value").alias("mean_least"))
    out = least.crossJoin(var(z, "_new")).crossJoin(var(v, "_old")).crossJoin(pairwise.silhouette(z).select("silhouette"))  # one row each
    return out.select("mean_least", (F.col("_new") / F.col("_old")).alias("variance_ratio"), "silhouette")


@query("standard_scale", """WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), s AS (SELECT dim, avg(x) AS mean, stddev_pop(x) AS sd FROM e GROUP BY dim)
    SELECT vec_id, dim, CASE WHEN sd = 0 THEN 0 ELSE (x - mean) / sd END AS z FROM e JOIN s USING (dim)""", "z")
def standard_scale(spark, sf):
    return scaled(vectors(spark, sf)).select("vec_id", F.posexplode("v").alias("dim", "z"))
