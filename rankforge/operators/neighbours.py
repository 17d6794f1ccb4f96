"""Exact nearest neighbours that leave out what the triangle inequality rules out.

Vectors are dealt to the nearest of a bounded number of pivots, large parts in several blocks. The neighbours inside a vector's own block
bound how far its k-th can be; it then visits only parts whose ball (and hollow around the pivot) may hold something nearer. What
is visited is compared in blocks on both sides, so no task's memory grows with the table, and each visit gives at most k rows. On vectors that
lie in clusters few parts are visited; on vectors without structure all are, which costs what comparing all blocks costs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking
from .keep import stored

#: Most pivots (their vectors are held by the driver and every task), vectors to a part that pivots are chosen for, and vectors to a block.
PIVOTS, PART, BLOCK = 512, 512, 2048
#: Blocks are exchanged in runs of at most ``WIDE`` of them; a table is dealt to ``SIDES`` runs where that suffices.
WIDE, SIDES = 32, 8
#: What rounding of distances to six digits may hide.
SLACK = 2e-6


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T), 0.0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _best(a: np.ndarray, b: np.ndarray, far: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of each row, by distance to six digits, then id; infinite ones don't count."""
    rounded = np.round(far, 6)
    n = min(k, far.shape[1])
    edge = np.partition(rounded, n - 1, axis=1)[:, n - 1 : n]
    i, j = np.nonzero((rounded <= edge) & np.isfinite(far))
    order = np.lexsort((b[j], rounded[i, j], i))
    i, j = i[order], j[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return pd.DataFrame({"a": a[i[keep]], "b": b[j[keep]], "value": far[i[keep], j[keep]]})


_EMPTY = {"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "value": pd.Series([], dtype="float64")}


class Parts:
    """Vectors dealt to pivots, with each one's bound: ``rows(vec_id, v, part, block, bound)``, and what is known of the parts."""

    def __init__(self, vectors: DataFrame, k: int):
        self.k, self.vectors = k, stored(vectors.select("vec_id", "v").where("v IS NOT NULL"), "vectors")
        self.n = self.vectors.count()
        m = int(max(1, min(PIVOTS, -(-self.n // PART))))
        chosen = self.vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(m).collect()  # at most PIVOTS rows
        pivots = np.array([r.v for r in chosen], dtype=np.float64)

        def deal(frames):
            for pdf in frames:
                if len(pdf):
                    far = _distances(_matrix(pdf["v"]), pivots)
                    part = far.argmin(1)
                    yield pdf.assign(part=part.astype("int32"), r=far[np.arange(len(pdf)), part])

        self.pivots = pivots
        self.dealt = stored(self.vectors.mapInPandas(deal, "vec_id long, v array<double>, part int, r double"), "dealt")
        stats = {r.part: r for r in self.dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()}  # a row for each pivot
        self.sizes = np.array([stats[p].n if p in stats else 0 for p in range(len(pivots))])
        self.low, self.high = (np.array([getattr(stats[p], c) if p in stats else 0.0 for p in range(len(pivots))]) for c in ("low", "high"))
        self.blocks = (-(-self.sizes // BLOCK)).astype(np.int64)
        self.reach = max(min(BLOCK, self.n), min(WIDE * BLOCK, -(-self.n // SIDES)), 1)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)])[:-1]  # blocks in the order of their parts
        self.part_of = np.repeat(np.arange(len(pivots)), self.blocks)
        filled = np.repeat(self.sizes / np.maximum(self.blocks, 1), self.blocks)
        self.run_of = (np.maximum(np.cumsum(filled) - 1, 0) // self.reach).astype(np.int64)
        blocks = F.array(*[F.lit(max(1, int(b))) for b in self.blocks]) if len(pivots) else F.array(F.lit(1))
        placed = self.dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.get(blocks, F.col("part"))).cast("int"))

        def own(pdf):
            ids, x = pdf["vec_id"].to_numpy(), _matrix(pdf["v"])
            far = np.where(ids[:, None] == ids[None, :], np.inf, _distances(x, x))
            best = _best(ids, ids, far, k)
            bound = np.partition(far, k - 1, axis=1)[:, k - 1] if len(ids) >= k else np.full(len(ids), np.inf)
            found = best.groupby("a").apply(lambda g: list(zip(g["b"], g["value"])), include_groups=False).reindex(ids).to_list() if len(best) else [None] * len(ids)
            return pdf[["vec_id", "v", "part", "block"]].assign(bound=bound, near=[[{"b": b, "value": v} for b, v in f] if isinstance(f, list) else [] for f in found])

        made = placed.groupBy("part", "block").applyInPandas(own, "vec_id long, v array<double>, part int, block int, bound double, near array<struct<b:long,value:double>>")
        self.rows = stored(made, "bounded")

    def visits(self) -> DataFrame:
        """``vec_id, v, bound, to, to_block``: the blocks besides its own that may hold one of a vector's k nearest."""
        pivots, low, high, blocks, sizes = self.pivots, self.low, self.high, self.blocks, self.sizes

        def reach(frames):
            for pdf in frames:
                if not len(pdf):
                    continue
                far, bound = _distances(_matrix(pdf["v"]), pivots), pdf["bound"].to_numpy()[:, None] * (1 + 1e-9) + SLACK
                may = (far - high <= bound) & (low - far <= bound) & (sizes > 0)
                i, q = np.nonzero(may)
                times = blocks[q]
                i, q = np.repeat(i, times), np.repeat(q, times)
                block = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
                other = (q != pdf["part"].to_numpy()[i]) | (block != pdf["block"].to_numpy()[i])
                i, q, block = i[other], q[other], block[other]
                for at in range(0, len(i), 16_384):  # vectors are repeated, so in small frames
                    s = slice(at, at + 16_384)
                    yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy()[i[s]], "v": pdf["v"].to_numpy()[i[s]], "bound": pdf["bound"].to_numpy()[i[s]], "to": q[s].astype("int32"), "to_block": block[s].astype("int32")})

        return self.rows.select("vec_id", "v", "part", "block", "bound").mapInPandas(reach, "vec_id long, v array<double>, bound double, to int, to_block int")

    def run_visits(self) -> DataFrame:
        """``vec_id, v, bound, mine, to``: its block, and the runs of blocks that hold one it has to visit, each once."""
        pivots, low, high, first, run_of, blocks = self.pivots, self.low, self.high, self.first, self.run_of, self.blocks

        def reach(frames):
            for pdf in frames:
                for at in range(0, len(pdf), 1024):  # vectors are repeated, so in small frames
                    own = pdf.iloc[at : at + 1024]
                    may = _may(_distances(_matrix(own["v"]), pivots), own["bound"].to_numpy(), low, high)
                    wide = np.repeat(may, blocks, axis=1)  # a column for each block
                    mine = first[own["part"].to_numpy()] + own["block"].to_numpy()
                    wide[np.arange(len(own)), mine] = False
                    i, to = np.nonzero(np.stack([wide[:, run_of == r].any(1) for r in range(run_of.max() + 1)], axis=1))
                    yield pd.DataFrame({"vec_id": own["vec_id"].to_numpy()[i], "v": own["v"].to_numpy()[i], "bound": own["bound"].to_numpy()[i], "mine": mine[i].astype("int32"), "to": to.astype("int32")})

        return self.rows.select("vec_id", "v", "part", "block", "bound").mapInPandas(reach, "vec_id long, v array<double>, bound double, mine int, to int")


def _may(far: np.ndarray, bound: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a part's ball, and the hollow around its pivot, leave room for something within a vector's bound."""
    bound = bound[:, None] * (1 + 1e-9) + SLACK
    return (far - high <= bound) & (low - far <= bound)


def visited_share(parts: Parts) -> DataFrame:
    """``vectors, blocks, visits, share``: how much of all vectors with all other blocks has to be compared."""
    every = float(max(1, parts.n * (int(parts.blocks.sum()) - 1)))
    return parts.visits().agg(F.count(F.lit(1)).alias("visits")).select(F.lit(parts.n).alias("vectors"), F.lit(int(parts.blocks.sum())).alias("blocks"), "visits", (F.col("visits") / every).alias("share"))


def nearest(vectors: DataFrame, k: int) -> DataFrame:
    """``a, b, value, rank``: the k nearest others of each vector by Euclidean distance to six digits, then id. Null vectors have and are no neighbours."""
    parts = Parts(vectors, k)
    inside = parts.rows.select(F.col("vec_id").alias("a"), F.explode("near").alias("x")).select("a", "x.b", "x.value")
    visits, wide = parts.run_visits(), parts.reach
    loads = stored(visits.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / wide).cast("int").alias("chunks")), "loads")  # a row for each run
    listed = lambda xs: F.array(*[F.lit(int(x)) for x in xs]) if len(xs) else F.array(F.lit(0))
    rows = parts.rows.withColumn("at", (F.get(listed(parts.first), F.col("part")) + F.col("block")).cast("int"))
    left = visits.join(F.broadcast(loads), "to").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).select("vec_id", "v", "bound", "mine", "to", "chunk")
    right = rows.select("vec_id", "v", "at", F.get(listed(parts.run_of), F.col("at")).cast("int").alias("to")).join(F.broadcast(loads), "to")
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("vec_id", "v", "at", "to", "chunk")
    pivots, low, high, part_of = parts.pivots, parts.low, parts.high, parts.part_of

    def compare(key, q, c):
        """Products of bounded size: some vectors with a part's, as far as the bound lets them."""
        if not len(q) or not len(c):
            return pd.DataFrame(_EMPTY)
        out, sides = [], []
        for block, own in c.groupby("at"):
            sides.append((block, own["vec_id"].to_numpy(), _matrix(own["v"])))
        for at in range(0, len(q), BLOCK):
            some = q.iloc[at : at + BLOCK]
            a, x, bound, mine = some["vec_id"].to_numpy(), _matrix(some["v"]), some["bound"].to_numpy(), some["mine"].to_numpy()
            may, own = _may(_distances(x, pivots), bound, low, high), []
            for block, b, y in sides:
                rows = np.flatnonzero(may[:, part_of[block]] & (mine != block))
                if len(rows):
                    far = _distances(x[rows], y)
                    gone = (a[rows, None] == b[None, :]) | (far > bound[rows, None] * (1 + 1e-9) + SLACK)
                    own.append(_best(a[rows], b, np.where(gone, np.inf, far), k))
            if own:
                own = pd.concat(own)
                own = own.assign(_r=own["value"].round(6)).sort_values(["a", "_r", "b"]).drop(columns="_r")
                out.append(own[own.groupby("a").cumcount() < k])
        return pd.concat(out) if out else pd.DataFrame(_EMPTY)

    keys = ["to", "chunk"]
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))  # new identities: both are of one origin
    outside = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a long, b long, value double")
    return ranking.top_k(inside.unionByName(outside), k, ["a"], "value", ["b"], descending=False)
