"""Queries of embedding-space experiments. Noise comes from hashes, so a rerun gives the same vectors."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..operators import blocks
from ..operators import evaluate as E
from ..operators import expand as X
from ..operators import manifold as M
from ..operators.expand import standard_scale as scaled
from ..operators.keep import stored
from .common import spread, vectors
from .registry import query


def described(spark, sf):
    return stored(X.described(vectors(spark, sf)), "described")


def _register(family: str) -> None:
    @query(f"expand_{family}")
    def run(spark, sf):
        """The expanded vectors of each configuration."""
        rows, out = described(spark, sf), None
        for dims, scale in X.FAMILIES[family][0]:
            made = X.expand(rows, family, dims, scale).select(F.lit(f"{family}_{dims}").alias("config"), "vec_id", "v")
            out = made if out is None else out.unionByName(made)
        return out


for _family in X.FAMILIES:
    _register(_family)


def configured():
    """``config, family, dimensions, scale`` of every configuration of every family."""
    return [(f"{family}_{dims}", family, dims, scale) for family, (configs, _, _) in X.FAMILIES.items() for dims, scale in configs]


def configurations(rows, side="doc"):
    """``config, vec_id, label, v``: the expanded vectors of every configuration."""
    out = None
    for config, family, dims, scale in configured():
        made = X.expand(rows, family, dims, scale, side).select(F.lit(config).alias("config"), "vec_id", "label", "v")
        out = made if out is None else out.unionByName(made)
    return out


def asked(spark, sf):
    """Every fiftieth vector as a query; its noise is drawn apart from the documents'."""
    return described(spark, sf).where("vec_id % 50 = 0")


@query("expand_query")
def expand_query(spark, sf):
    return configurations(asked(spark, sf), "query").select("config", "vec_id", "v")


@query("expansion_eval")
def expansion_eval(spark, sf):
    """Each configuration by language (the parity of the label): how well an expanded query finds its own expanded vector."""
    rows = stored(spread(described(spark, sf).where("v IS NOT NULL")), "rows")
    asked, kept = rows.where("vec_id % 50 = 0"), [c for c in rows.columns if c not in ("vec_id", "label")]
    queries, docs = None, {}
    for config, family, dims, scale in configured():
        docs[config] = rows, partial(X.expanded, draw=X.noise(family, dims, scale))
        own = X.expand(asked.withColumn("_v", F.col("v")), family, dims, scale, keep=[*(c for c in kept if c != "v"), "_v"]).withColumnsRenamed({"v": "_own", "_v": "v"})
        made = X.expand(own, family, dims, scale, "query", ["_own"]).select(F.lit(config).alias("group"), "vec_id", "label", "v", F.coalesce(cosine(F.col("v"), F.col("_own")), F.lit(0.0)).alias("own"))
        queries = made if queries is None else queries.unionByName(made)
    queries = stored(queries, "queries")
    found = blocks.position_of_own(queries, docs).join(queries.select("group", F.col("vec_id").alias("query_id"), "label"), ["group", "query_id"])
    lang = F.when(F.col("label") % 2 == 0, "ca").otherwise("es").alias("lang")
    return E.topn_accuracy(found.select(F.col("group").alias("config"), lang, "position"), ["config", "lang"])


#: Numbers of components of the reductions and of the analysis.
REDUCTIONS, ANALYSED = (2, 5, 10, 15), 20


@query("pca")
def pca(spark, sf):
    """Centred projections on twenty components, which hold those on fewer; signs make the largest loading positive."""
    return X.pca(vectors(spark, sf), ANALYSED)[0].select("vec_id", F.posexplode("v").alias("component", "value"))


@query("pca_loadings")
def pca_loadings(spark, sf):
    """Weight of each dimension in each component of the standardised vectors."""
    axes = X.principal(_standard(spark, sf), ANALYSED).axes
    rows = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(axes)], "component int, axis array<double>")
    return rows.select("component", F.posexplode("axis").alias("dimension", "loading"))


@query("component_importance")
def component_importance(spark, sf):
    """Of the standardised vectors: share of variance, its running sum, and the standard deviation along each component."""
    made = X.principal(_standard(spark, sf), ANALYSED)
    rows = zip(made.shares.tolist(), made.shares.cumsum().tolist(), made.deviations.tolist())
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "component int, share double, cumulative double, deviation double")


@query("pca_reductions")
def pca_reductions(spark, sf):
    """Each reduction: variance it explains and how well a projected query (every fiftieth vector, by the same fit) finds its own among all by cosine."""
    v = vectors(spark, sf).where("v IS NOT NULL").select("vec_id", "v")
    made = X.principal(v, max(REDUCTIONS))
    long = stored(made.project(v), "projected")
    out = None
    for d in REDUCTIONS:
        short = long.select("vec_id", F.slice("v", 1, d).alias("v"))
        one = blocks.own_position(short.where("vec_id % 50 = 0"), short).withColumn("dims", F.lit(d))
        out = one if out is None else out.unionByName(one)
    found = E.topn_accuracy(out, ["dims"])
    share = F.element_at(F.create_map(*[F.lit(x) for d in REDUCTIONS for x in (d, float(made.shares[:d].sum()))]), F.col("dims"))
    return found.withColumn("explained", share)


@query("cumulative_variance")
def cumulative_variance(spark, sf):
    from ..operators.ranking import cumulative_share

    made = X.principal(vectors(spark, sf), 64)
    rows = spark.createDataFrame([(0, i, float(s), float(d)) for i, (s, d) in enumerate(zip(made.shares, made.deviations))], "g int, component int, share double, deviation double")
    return cumulative_share(rows, "share", [F.col("component")], ["g"]).select("component", "share", "cumulative", "deviation")


@query("kmeans_silhouette")
def kmeans_silhouette(spark, sf):
    """Exact silhouette of MLlib's clusters."""
    from ..operators.pairwise import silhouette

    v = vectors(spark, sf)
    return silhouette(v.select("vec_id", "v").join(X.kmeans(v, 8), "vec_id").withColumnRenamed("cluster", "label"))


def _standard(spark, sf):
    return stored(scaled(vectors(spark, sf).where("v IS NOT NULL").select("vec_id", "v")), "scaled")


#: Fixed values, those of the reference's library: perplexity (three times as many neighbours, and one), steps of the map, and those of them that exaggerate.
PERPLEXITY, STEPS, EARLY = 30, 1000, 250


@query("tsne")
def tsne(spark, sf):
    """A map of all vectors, standardised first: perplexity 30 over 91 neighbours, 1000 steps; tests hold its parts against plain Python."""
    v = _standard(spark, sf)
    edges = stored(M.affinities(M.neighbour_graph(v, 3 * PERPLEXITY + 1), float(PERPLEXITY)), "edges")
    return M.tsne(edges, v.select(F.col("vec_id").alias("i")), steps=STEPS, early=EARLY).select(F.col("i").alias("vec_id"), F.col("y0").alias("x"), F.col("y1").alias("y"))


@query("umap")
def umap(spark, sf):
    """A map of all vectors, standardised first: 15 neighbours by cosine, 30 epochs."""
    v = _standard(spark, sf)
    edges = stored(M.memberships(M.neighbour_graph(v, 15, by_cosine=True)), "edges")
    return M.umap(edges, v.select(F.col("vec_id").alias("i")), epochs=30).select(F.col("i").alias("vec_id"), F.col("y0").alias("x"), F.col("y1").alias("y"))
