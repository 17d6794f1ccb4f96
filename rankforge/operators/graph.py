"""Chunk graphs and personalised PageRank, a graph for each query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_links(nodes: DataFrame, links: DataFrame | None) -> DataFrame:
    """``nodes`` with ``links``: the chunks each one is linked with, either way, as often as it is."""
    if links is None:
        return nodes.withColumn("links", F.array().cast(f"array<{nodes.schema['chunk_id'].dataType.simpleString()}>"))
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).join(nodes.select(F.col("chunk_id").alias("src")).distinct(), "src", "left_semi")
    listed = both.groupBy(F.col("src").alias("chunk_id")).agg(F.collect_list("dst").alias("links"))
    return nodes.join(listed, "chunk_id", "left")


def _dense(own: pd.DataFrame, weights: tuple[float, float, float], keep: float, decay: float) -> np.ndarray:
    """The symmetric weights of one query's candidates, in their order; 0 where there is no edge."""
    n, filled = len(own), [e for e in own["embedding"] if e is not None]
    v = np.zeros((n, len(filled[0]) if filled else 1))
    for i, e in enumerate(own["embedding"]):
        if e is not None:
            v[i] = e
    norm = np.sqrt((v * v).sum(1))
    near = np.divide(v @ v.T, norm[:, None] * norm[None, :], out=np.zeros((n, n)), where=norm[:, None] * norm[None, :] > 0)
    doc, place = pd.factorize(own["doc"])[0], own["position"].to_numpy(np.float64)
    inside = np.where((doc[:, None] == doc[None, :]) & (doc[:, None] >= 0), np.exp(-np.abs(place[:, None] - place[None, :]) / decay), 0.0)
    ids = own["chunk_id"].to_numpy()
    linked = np.zeros((n, n))
    order = np.argsort(ids, kind="stable")
    for i, other in enumerate(own["links"]):
        if other is not None and len(other):
            at = np.searchsorted(ids[order], other)
            at = order[at[(at < n) & (ids[order][np.minimum(at, n - 1)] == other)]]
            np.add.at(linked[i], at, 1.0)
    made = np.round(weights[0] * near + weights[1] * inside + weights[2] * linked, 9)
    return np.where((made > keep) & (ids[:, None] != ids[None, :]), made, 0.0)


def build_graph(nodes: DataFrame, links: DataFrame | None = None, weights: tuple[float, float, float] = (0.6, 0.25, 0.15), keep: float = 0.01, decay: float = 5.0) -> DataFrame:
    """``query_id, src, dst, weight`` over ``nodes(query_id, chunk_id, doc, position, embedding)``.

    alpha * cosine + beta * exp(-distance / 5) inside a document + gamma for each link either way. A query's nodes are its
    candidates, a bounded list, whose weights are one small matrix in one task.
    """

    def edges(key, own):
        w, ids = _dense(own, weights, keep, decay), own["chunk_id"].to_numpy()
        i, j = np.nonzero(w)
        return pd.DataFrame({"query_id": key[0], "src": ids[i], "dst": ids[j], "weight": w[i, j]})

    kind = nodes.schema["chunk_id"].dataType.simpleString()
    rows = with_links(nodes.select("query_id", "chunk_id", "doc", "position", "embedding"), links)
    return rows.groupBy("query_id").applyInPandas(edges, f"query_id {nodes.schema['query_id'].dataType.simpleString()}, src {kind}, dst {kind}, weight double")


def ppr_of_nodes(nodes: DataFrame, links: DataFrame | None, n_seeds: int, damping: float = 0.85, tol: float = 1e-6, iterations: int = 100, weights: tuple[float, float, float] = (0.6, 0.25, 0.15), keep: float = 0.01, decay: float = 5.0) -> DataFrame:
    """``ppr`` of ``build_graph`` with the ``n_seeds`` first by ``rank``: each query's graph is made and solved in one task, and no edge leaves it."""

    def solve(key, own):
        own = own.drop_duplicates("chunk_id").sort_values("chunk_id", ignore_index=True)
        src, dst = np.nonzero(w := _dense(own, weights, keep, decay))
        seed = (own["rank"] <= n_seeds).to_numpy()
        restart = seed / max(1, seed.sum())
        p = pagerank(src, dst, w[src, dst], restart, damping, tol, iterations) if seed.any() else np.zeros(len(own))
        return pd.DataFrame({"query_id": key[0], "chunk_id": own["chunk_id"], "score": p})

    kinds = [f"{c} {nodes.schema[c].dataType.simpleString()}" for c in ("query_id", "chunk_id")]
    rows = with_links(nodes.select("query_id", "chunk_id", "doc", "position", "embedding", "rank"), links)
    return rows.groupBy("query_id").applyInPandas(solve, f"{', '.join(kinds)}, score double")


def graph_enhanced(nodes: DataFrame, edges: DataFrame, decay: float = 5.0, beta: float = 0.25, reach: int = 2) -> DataFrame:
    """Adds edges to the next ``reach`` chunks of a document in position order, where there is none yet."""
    order = Window.partitionBy("query_id", "doc").orderBy("position", "chunk_id")
    placed = nodes.select("query_id", "doc", "chunk_id", "position", F.row_number().over(order).alias("rn"))
    ahead = placed.select("query_id", "doc", F.col("chunk_id").alias("dst"), F.col("position").alias("p2"), F.explode(F.array(*[F.col("rn") - i for i in range(1, reach + 1)])).alias("rn"))
    near = placed.join(ahead, ["query_id", "doc", "rn"]).select("query_id", F.col("chunk_id").alias("src"), "dst", (beta * F.exp(-F.abs(F.col("position") - F.col("p2")) / decay)).alias("weight"))
    both = near.unionByName(near.select("query_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return edges.unionByName(both.join(edges, ["query_id", "src", "dst"], "left_anti"))


def _apart(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that frames of common origin can be grouped together."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def pagerank(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, restart: np.ndarray, damping: float, tol: float, iterations: int, transition: str = "raw") -> np.ndarray:
    """Restart-biased power iteration, rescaled to sum 1; ``stochastic`` divides weights by their row sums first."""
    n = len(restart)
    if transition == "stochastic":
        out = np.bincount(src, weight, n)
        weight = weight / out[src] if len(src) else weight
        dangling = out == 0
    p = restart.copy() if restart.sum() else np.full(n, 1 / n)
    for _ in range(iterations):
        moved = np.bincount(dst, p[src] * weight, n)
        if transition == "stochastic":
            moved += np.where(dangling, p, 0.0)
        new = (1 - damping) * restart + damping * moved
        total = new.sum()
        new = new / total if total > 0 else new
        done, p = np.abs(new - p).sum() < tol, new
        if done:
            break
    return p


def ppr(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tol: float = 1e-6, iterations: int = 100, transition: str = "raw", teleport: float = 0.0) -> DataFrame:
    """``query_id, chunk_id, score``: one bounded graph for each query, one exchange.

    ``teleport`` > 0 gives that much of the restart mass to the nodes that are no seeds.
    """

    def solve(key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = own["chunk_id"].drop_duplicates().sort_values().to_numpy()
        is_seed = np.isin(ids, own["chunk_id"][own["is_seed"]].to_numpy())
        k, n = int(is_seed.sum()), len(ids)
        if k == 0:
            return pd.DataFrame({"query_id": key[0], "chunk_id": ids, "score": np.zeros(n)})
        restart = is_seed / k
        if teleport and n > k:
            restart = np.where(is_seed, (1 - teleport) / k, teleport / (n - k))
        links = links.sort_values(["src", "dst"])
        links = links[links["src"].isin(ids) & links["dst"].isin(ids)]
        at = lambda c: np.searchsorted(ids, links[c].to_numpy())
        p = pagerank(at("src"), at("dst"), links["weight"].to_numpy(np.float64), restart.astype(np.float64), damping, tol, iterations, transition)
        return pd.DataFrame({"query_id": key[0], "chunk_id": ids, "score": p})

    marked = nodes.select("query_id", "chunk_id").join(seeds.select("query_id", "chunk_id", F.lit(True).alias("is_seed")), ["query_id", "chunk_id"], "left").withColumn("is_seed", F.coalesce("is_seed", F.lit(False)))
    return _apart(marked).groupBy("query_id").cogroup(_apart(edges).groupBy("query_id")).applyInPandas(solve, "query_id long, chunk_id long, score double")


def l1_diff(a: DataFrame, b: DataFrame, by: list[str], key: str = "chunk_id", score: str = "score") -> DataFrame:
    right = b.select(*by, key, F.col(score).alias("_other"))
    return a.join(right, [*by, key], "full").groupBy(*by).agg(F.sum(F.abs(F.coalesce(score, F.lit(0.0)) - F.coalesce("_other", F.lit(0.0)))).alias("l1"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, nodes, edges, density``."""
    n = nodes.groupBy("query_id").agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.groupBy("query_id").agg(F.count(F.lit(1)).alias("edges"))
    out = n.join(m, "query_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return out.withColumn("density", F.coalesce(F.try_divide(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, clustering``: mean over nodes of the directed, unweighted clustering coefficient.

    For a symmetric graph, triangles through a node over the pairs of its neighbours.
    """
    e = edges.select("query_id", F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct()
    degree = e.groupBy("query_id", "a").agg(F.count(F.lit(1)).alias("d"))
    wedge = e.join(e.select("query_id", "a", F.col("b").alias("c")), ["query_id", "a"]).where("b <> c")
    closed = wedge.join(e.select("query_id", F.col("a").alias("b"), F.col("b").alias("c")), ["query_id", "b", "c"], "left_semi")
    t = closed.groupBy("query_id", "a").agg(F.count(F.lit(1)).alias("t"))
    per = nodes.select("query_id", F.col("chunk_id").alias("a")).join(degree, ["query_id", "a"], "left").join(t, ["query_id", "a"], "left")
    c = F.coalesce(F.try_divide(F.coalesce("t", F.lit(0)).cast("double"), F.col("d") * (F.col("d") - 1)), F.lit(0.0))
    return per.groupBy("query_id").agg(F.avg(c).alias("clustering"))


def average_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``query_id, average_path``: mean shortest path in steps; null unless every node reaches every other."""

    def walk(key, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(own["chunk_id"].to_numpy())
        n = len(ids)
        near = np.zeros((n, n), bool)
        near[np.searchsorted(ids, links["src"].to_numpy()), np.searchsorted(ids, links["dst"].to_numpy())] = True
        reached, front, total, step = np.eye(n, dtype=bool), np.eye(n, dtype=bool), 0, 0
        while front.any():
            step += 1
            front = (front.astype(np.int32) @ near.astype(np.int32) > 0) & ~reached
            reached |= front
            total += step * int(front.sum())
        mean = total / (n * (n - 1)) if n > 1 and reached.all() else None
        return pd.DataFrame({"query_id": [key[0]], "average_path": pd.array([mean], dtype="Float64")})

    own = nodes.select("query_id", "chunk_id")
    return _apart(own).groupBy("query_id").cogroup(_apart(edges).groupBy("query_id")).applyInPandas(walk, "query_id long, average_path double")
