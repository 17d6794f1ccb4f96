"""Queries of rank and score ensembles; two halves of each vector stand for two models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import blocks
from ..operators import fusion as N
from ..operators import ranking
from ..operators.keep import stored
from .common import vectors
from .registry import query
from .vectors import VEC

HALF = 32
#: The two models' weights.
WEIGHTS = {"even": 0.571, "odd": 0.429}


def scored(q, c):
    """Scores of a block by both half vectors, to nine digits; where either side lacks a vector, minus infinity."""
    x, y = q.v, c.v
    made = [np.concatenate([blocks.nine(blocks.cosine(x[t, k::2], y[:, k::2])) for t in blocks.tiles(len(q.ids))]) for k in (0, 1)]
    for m in made:
        m[~(q.ok[:, None] & c.ok[None, :])] = -np.inf
    return made


def halves(spark, sf, run, schema, more=None):
    """``run(q, c, even, odd)`` of each block of queries (every fiftieth vector, the stated query set) with each block of all vectors; ``more`` goes with the queries."""
    v = vectors(spark, sf).select("vec_id", "label", "v")
    q = v.where("vec_id % 50 = 0")
    return blocks.meet(q if more is None else q.join(more, "vec_id"), v, lambda q, c: run(q, c, *scored(q, c)), schema)


NAMES = np.array(["even", "odd", "fused"])


MODELS = f"""{VEC}, h AS MATERIALIZED (SELECT vec_id, label, list_filter(v, lambda x, i: i % 2 = 1) AS e, list_filter(v, lambda x, i: i % 2 = 0) AS o FROM v),
    ms AS MATERIALIZED (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, c.vec_id % 20 AS doc, unnest(['even', 'odd']) AS model, round(unnest([list_cosine_similarity(c.e, q.e), list_cosine_similarity(c.o, q.o)]), 9) AS score FROM h c CROSS JOIN h q WHERE q.vec_id % 50 = 0),
    best AS (SELECT query_id, model, doc, max(score) AS score FROM ms GROUP BY ALL), wt AS (SELECT * FROM (VALUES ('even', 0.571), ('odd', 0.429)) t(model, weight)),
    wavg AS (SELECT query_id, doc, 100 * sum(weight * score) AS score FROM best JOIN wt USING (model) GROUP BY ALL),
    mr AS (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM ms),
    rrf AS (SELECT query_id, doc, 100 * sum(weight / (60.0 + rank)) AS score FROM mr JOIN wt USING (model) WHERE rank <= 20 GROUP BY ALL),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY round(score, 6) DESC, doc) AS rank FROM best)"""


def _top5(name: str) -> str:
    return f"SELECT * FROM (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc) AS rank FROM {name}) WHERE rank <= 5"


def weights(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "model string, weight double").coalesce(1)


DOCS = 20


def doc_best(spark, sf):
    """``query_id, model, doc, score``: the best chunk of each document, from the best of each block."""

    def run(q, c, *scores):
        doc, out = c.ids % DOCS, []
        order = np.argsort(doc, kind="stable")
        kinds, first = np.unique(doc[order], return_index=True)
        for name, s in zip(NAMES, scores):
            most = np.maximum.reduceat(s[:, order], first, axis=1).ravel()
            found = most > -np.inf
            out.append(pa.table({"query_id": np.repeat(q.ids, len(kinds))[found], "model": [name] * int(found.sum()), "doc": np.tile(kinds, len(q.ids))[found], "score": most[found]}))
        return pa.concat_tables(out)

    return halves(spark, sf, run, "query_id long, model string, doc long, score double").groupBy("query_id", "model", "doc").agg(F.max("score").alias("score"))


def chunk_best(spark, sf, k):
    """``query_id, model, chunk_id, doc, score, rank`` of the k best chunks, from the k best of each block."""

    def run(q, c, *scores):
        out = []
        for name, s in zip(NAMES, scores):
            at, to = blocks.firsts(blocks.units(s), k)
            out.append(pa.table({"query_id": q.ids[at], "model": [name] * len(at), "chunk_id": c.ids[to], "doc": c.ids[to] % DOCS, "score": s[at, to]}))
        return pa.concat_tables(out)

    return ranking.top_k(halves(spark, sf, run, "query_id long, model string, chunk_id long, doc long, score double"), k, ["query_id", "model"])


@query("weighted_average_fusion", f"WITH {MODELS} {_top5('wavg')}", "score")
def weighted_average_fusion(spark, sf):
    fused = N.weighted_average_fusion(doc_best(spark, sf), weights(spark), ["query_id"])
    return ranking.top_k(fused, 5, ["query_id"], "score", ["doc"])


@query("rrf_fusion", f"WITH {MODELS} {_top5('rrf')}", "score")
def rrf_fusion(spark, sf):
    ranked = chunk_best(spark, sf, 20)
    return ranking.top_k(N.rrf_fusion(ranked, weights(spark), ["query_id"]), 5, ["query_id"], "score", ["doc"])


def doc_ranked(spark, sf, k=5):
    return ranking.top_k(doc_best(spark, sf), k, ["query_id", "model"], "score", ["doc"])


@query("agreement", f"WITH {MODELS} SELECT query_id, 1.0 / count(DISTINCT doc) AS agreement FROM dr WHERE rank = 1 GROUP BY query_id", "agreement")
def agreement(spark, sf):
    return doc_ranked(spark, sf, 1).groupBy("query_id").agg((1.0 / F.countDistinct("doc")).alias("agreement"))


@query("pairwise_top5_overlap", f"WITH {MODELS} SELECT a.model AS a, b.model AS b, avg(n) AS overlap FROM (SELECT 'even' AS model) a, (SELECT 'odd' AS model) b, (SELECT query_id, (SELECT count(*) FROM dr x JOIN dr y ON x.query_id = y.query_id AND x.doc = y.doc WHERE x.query_id = q.query_id AND x.model = 'even' AND y.model = 'odd' AND x.rank <= 5 AND y.rank <= 5) / 5.0 AS n FROM (SELECT DISTINCT query_id FROM dr) q) GROUP BY ALL", "overlap")
def pairwise_top5_overlap(spark, sf):
    sets = doc_ranked(spark, sf).groupBy("query_id", "model").agg(F.collect_set("doc").alias("docs"))  # five each
    a, b = sets.select("query_id", F.col("model").alias("a"), F.col("docs").alias("x")), sets.select("query_id", F.col("model").alias("b"), F.col("docs").alias("y"))
    return a.join(b, "query_id").where("a < b").groupBy("a", "b").agg(F.avg(F.size(F.array_intersect("x", "y")) / 5.0).alias("overlap"))


@query("union_docs", f"WITH {MODELS} SELECT DISTINCT query_id, doc FROM dr WHERE rank <= 5")
def union_docs(spark, sf):
    return doc_ranked(spark, sf).select("query_id", "doc").distinct()


def model_pairs(spark, sf):
    m = spark.createDataFrame([("even",), ("odd",), ("full",)], "a string")
    return m.join(m.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))


_GRID = "g AS (SELECT a.x * 0.571 AS even, b.x * 0.429 AS odd, a.x AS ax, b.x AS bx FROM (SELECT unnest([0.5, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.5]) AS x) a CROSS JOIN (SELECT unnest([0.5, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.5]) AS x) b)"
#: Multipliers of the weight search.
MULTIPLIERS = [0.5, 0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.5]


def grid(spark):
    m = spark.createDataFrame([(x,) for x in MULTIPLIERS], "ax double").coalesce(1)
    return m.crossJoin(m.withColumnRenamed("ax", "bx")).select("ax", "bx", (F.col("ax") * WEIGHTS["even"]).alias("even"), (F.col("bx") * WEIGHTS["odd"]).alias("odd"))


def weight_grid(spark, sf):
    total = F.col("even") + F.col("odd")
    return grid(spark).select("ax", "bx", (F.col("even") / total).alias("even"), (F.col("odd") / total).alias("odd"))


@query("weight_search", f"""WITH {MODELS}, {_GRID}, t AS (SELECT ax, bx, e.query_id, e.doc, (even * e.score + odd * o.score) / (even + odd) AS score FROM g CROSS JOIN (SELECT * FROM best WHERE model = 'even') e JOIN (SELECT * FROM best WHERE model = 'odd') o ON e.query_id = o.query_id AND e.doc = o.doc),
    r AS (SELECT *, row_number() OVER (PARTITION BY ax, bx, query_id ORDER BY round(score, 6) DESC, doc) AS rank FROM t) SELECT ax, bx, avg(CASE WHEN doc = query_id % 20 THEN 1.0 ELSE 0.0 END) AS acc1 FROM r WHERE rank = 1 GROUP BY ALL""", "ax bx acc1")
def weight_search(spark, sf):
    """Every grid point over the same document scores, in one job."""
    b = doc_best(spark, sf).groupBy("query_id", "doc").pivot("model", ["even", "odd"]).agg(F.max("score"))
    g = grid(spark).withColumnsRenamed({"even": "we", "odd": "wo"})
    t = b.crossJoin(F.broadcast(g)).withColumn("score", (F.col("we") * F.col("even") + F.col("wo") * F.col("odd")) / (F.col("we") + F.col("wo")))
    r = ranking.top_k(t, 1, ["ax", "bx", "query_id"], "score", ["doc"])
    return r.groupBy("ax", "bx").agg(F.avg(F.when(F.col("doc") == F.col("query_id") % 20, 1.0).otherwise(0.0)).alias("acc1"))


def param_grid(spark, sf):
    g = spark.createDataFrame([("l2",), ("none",), ("z",)], "normalize string").crossJoin(spark.createDataFrame([(8,), (16,), (32,), (64,)], "batch int"))
    return ranking.rank_by(g.withColumn("one", F.lit(1)), ["one"], "one", ["normalize", "batch"]).where("rank % 2 = 1").select("normalize", "batch")


#: A model is right where the best vector other than the query's own has the query's label; ``fused`` is the weighted average.
_OUTCOMES = f"""{MODELS}, fs AS (SELECT query_id, chunk_id, 'fused' AS model, sum(weight * score) AS score FROM ms JOIN wt USING (model) GROUP BY ALL),
    lr AS (SELECT *, row_number() OVER (PARTITION BY query_id, model ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, model, score FROM ms UNION ALL SELECT query_id, chunk_id, model, score FROM fs) WHERE chunk_id <> query_id),
    pos AS (SELECT lr.query_id, lr.model, min(rank) AS position FROM lr JOIN h q ON q.vec_id = lr.query_id JOIN h c ON c.vec_id = lr.chunk_id WHERE q.label = c.label GROUP BY ALL),
    ab AS (SELECT query_id, max(CASE WHEN model = 'even' THEN position END) AS a, max(CASE WHEN model = 'odd' THEN position END) AS b, max(CASE WHEN model = 'fused' THEN position END) AS f FROM pos GROUP BY query_id)"""


def outcomes(spark, sf):
    """``query_id, even, odd, fused``, stored: the rank of the first other vector of the query's label, by model.

    One pass finds the best of the label, a second counts what is not behind it; both see the pairs in their blocks only.
    """

    def three(q, c, even, odd):
        every = [even, odd, WEIGHTS["even"] * even + WEIGHTS["odd"] * odd]
        for s in every:
            s[q.ids[:, None] == c.ids[None, :]] = -np.inf
        return [blocks.units(s) for s in every]

    def same(q, c):
        codes = {}
        own, other = (np.array([-1 if x is None else codes.setdefault(x, len(codes)) for x in side.table.column("label").to_pylist()]) for side in (q, c))
        return (own[:, None] == other[None, :]) & (own[:, None] >= 0)

    def best(q, c, even, odd):
        alike, out = same(q, c), []
        for name, s in zip(NAMES, three(q, c, even, odd)):
            at, to = blocks.firsts(np.where(alike, s, -np.inf), 1)
            out.append(pa.table({"query_id": q.ids[at], "model": [name] * len(at), "s": s[at, to], "t": -c.ids[to]}))
        return pa.concat_tables(out)

    first = halves(spark, sf, best, "query_id long, model string, s double, t long").groupBy("query_id", "model").agg(F.max(F.struct("s", "t")).alias("b"))
    first = stored(first.groupBy(F.col("query_id").alias("vec_id")).pivot("model", NAMES.tolist()).agg(F.max("b")), "firsts")
    named = first.select("vec_id", *[F.coalesce(F.col(f"{m}.{x}"), F.lit(v)).alias(f"{m}_{x}") for m in NAMES.tolist() for x, v in (("s", float("inf")), ("t", 0))])

    def ahead(q, c, even, odd):
        out = {"query_id": q.ids}
        for name, s in zip(NAMES, three(q, c, even, odd)):
            least, t = q.column(f"{name}_s")[:, None], q.column(f"{name}_t")[:, None]
            out[str(name)] = ((s > least) | ((s == least) & (-c.ids[None, :] >= t))).sum(1)
        return out

    counts = halves(spark, sf, ahead, "query_id long, even long, odd long, fused long", named).groupBy("query_id")
    return stored(counts.agg(*[F.when(F.sum(m) > 0, F.sum(m)).alias(m) for m in NAMES.tolist()]), "outcomes")


def _right(p, name):
    return p.where(F.col(name) == 1).select("query_id")


@query("overlap_intersect", f"WITH {_OUTCOMES} SELECT query_id FROM ab WHERE a = 1 AND b = 1")
def overlap_intersect(spark, sf):
    p = outcomes(spark, sf)
    return _right(p, "even").intersect(_right(p, "odd"))


@query("overlap_only_a", f"WITH {_OUTCOMES} SELECT query_id FROM ab WHERE a = 1 AND b IS DISTINCT FROM 1")
def overlap_only_a(spark, sf):
    p = outcomes(spark, sf)
    return _right(p, "even").exceptAll(_right(p, "odd"))


@query("overlap_only_b", f"WITH {_OUTCOMES} SELECT query_id FROM ab WHERE b = 1 AND a IS DISTINCT FROM 1")
def overlap_only_b(spark, sf):
    p = outcomes(spark, sf)
    return _right(p, "odd").exceptAll(_right(p, "even"))


#: First places, and the bucket of places 2 to 5, of both models.
_PLACES = {"1": ("a = 1", "b = 1"), "5": ("a BETWEEN 2 AND 5", "b BETWEEN 2 AND 5")}


def _overlap_sql() -> str:
    out = ["count(*) AS n"]
    for k, (a, b) in _PLACES.items():
        a, b = f"coalesce({a}, false)", f"coalesce({b}, false)"
        parts = {f"a{k}": a, f"b{k}": b, f"both{k}": f"{a} AND {b}", f"only_a{k}": f"{a} AND NOT {b}", f"only_b{k}": f"{b} AND NOT {a}"}
        out += [f"count(*) FILTER (WHERE {c}) AS {name}" for name, c in parts.items()]
        out += [f"100.0 * count(*) FILTER (WHERE {parts[name]}) / count(*) AS {name}_percent" for name in (f"both{k}", f"only_a{k}", f"only_b{k}")]
    return ", ".join(out)


_PERCENTS = " ".join(f"{name}{k}_percent" for k in _PLACES for name in ("both", "only_a", "only_b"))


@query("overlap_report", f"WITH {_OUTCOMES} SELECT {_overlap_sql()} FROM ab", _PERCENTS)
def overlap_report(spark, sf):
    """How many queries each model has right, alone and with the other, at the first place and in the bucket from 2 to 5, also in percent of all."""
    n, made = (lambda c: F.count(F.when(c, 1))), [F.count(F.lit(1)).alias("n")]
    for k, low, high in (("1", 1, 1), ("5", 2, 5)):
        a, b = (F.coalesce(F.col(m).between(low, high), F.lit(False)) for m in ("even", "odd"))
        parts = {f"a{k}": a, f"b{k}": b, f"both{k}": a & b, f"only_a{k}": a & ~b, f"only_b{k}": b & ~a}
        made += [n(c).alias(name) for name, c in parts.items()]
        made += [(100.0 * n(parts[name]) / F.count(F.lit(1))).alias(f"{name}_percent") for name in (f"both{k}", f"only_a{k}", f"only_b{k}")]
    return outcomes(spark, sf).agg(*made)


@query("ensemble_unique_wins", f"WITH {_OUTCOMES} SELECT query_id FROM ab WHERE f = 1 AND a IS DISTINCT FROM 1 AND b IS DISTINCT FROM 1")
def ensemble_unique_wins(spark, sf):
    """Queries that the fused scores get right while both models are wrong."""
    p = outcomes(spark, sf)
    members = _right(p, "even").union(_right(p, "odd"))
    return _right(p, "fused").join(members, "query_id", "left_anti")


@query("diversity_analysis", f"""WITH {_OUTCOMES} SELECT (SELECT avg(agreement) FROM (SELECT 1.0 / count(DISTINCT doc) AS agreement FROM dr WHERE rank = 1 GROUP BY query_id)) AS agreement,
    (SELECT avg(n / 5.0) FROM (SELECT count(y.doc) AS n FROM (SELECT * FROM dr WHERE model = 'even' AND rank <= 5) x LEFT JOIN (SELECT * FROM dr WHERE model = 'odd' AND rank <= 5) y ON x.query_id = y.query_id AND x.doc = y.doc GROUP BY x.query_id)) AS top5_overlap,
    count(*) FILTER (WHERE a = 1) AS even_right, count(*) FILTER (WHERE b = 1) AS odd_right, count(*) FILTER (WHERE f = 1) AS fused_right, count(*) FILTER (WHERE a = 1 AND b IS DISTINCT FROM 1) AS even_alone, count(*) FILTER (WHERE b = 1 AND a IS DISTINCT FROM 1) AS odd_alone,
    count(*) FILTER (WHERE f = 1 AND a IS DISTINCT FROM 1 AND b IS DISTINCT FROM 1) AS unique_wins FROM ab""", "agreement top5_overlap")
def diversity_analysis(spark, sf):
    """Agreement and overlap of the models, what each contributes alone, and what only their ensemble gets right."""
    best = stored(doc_ranked(spark, sf), "ranked")
    agreed = best.where("rank = 1").groupBy("query_id").agg((1.0 / F.countDistinct("doc")).alias("x")).agg(F.avg("x").alias("agreement"))
    top = lambda m: best.where(F.col("model") == m).select("query_id", "doc")
    shared = top("even").join(top("odd").withColumn("_both", F.lit(1)), ["query_id", "doc"], "left").groupBy("query_id").agg((F.count("_both") / 5.0).alias("x")).agg(F.avg("x").alias("top5_overlap"))
    a, b, f = (F.coalesce(F.col(m) == 1, F.lit(False)) for m in ("even", "odd", "fused"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    counts = outcomes(spark, sf).agg(n(a, "even_right"), n(b, "odd_right"), n(f, "fused_right"), n(a & ~b, "even_alone"), n(b & ~a, "odd_alone"), n(f & ~a & ~b, "unique_wins"))
    return agreed.crossJoin(shared).crossJoin(counts)  # one row each
