"""Two-dimensional maps of vectors: t-SNE and UMAP over the exact neighbour graph.

Affinities come from a row for each vector that holds its own k neighbours. t-SNE deals vectors and their edges to bounded blocks once; in
each step a block sends the places that others' edges ask for (one exchange) and adds up its own attraction. The repulsion of all pairs comes
from a grid of bounded size: vectors spread a charge to nodes around them, the grid is convolved with the kernel by FFT, and each vector reads its
potential back, so the work of a step grows with edges and vectors, never with pairs. UMAP's epochs move both ends of sampled edges
and push away vertices drawn by hash. The driver sees sums, extents and the grid, or the places where these are less than a grid.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keep import deleted, deleted_on_exit, stored
from .neighbours import nearest
from .ranking import numbered

#: Most and least nodes of the grid to a side. Nodes are ``SPACING`` apart while ``FINE`` of them do, then a ``COARSE``, up to the most.
NODES, LEAST, SPACING, FINE, COARSE = 1024, 60, 0.2, 252, 1 / 3
#: Most places of a block, fewest of one where there are several, and blocks that a table is dealt to where these suffice.
WIDE, NARROW, SIDES = 65_536, 2048, 6
#: Edges of a record, and steps from one checkpoint of the places to the next.
EDGES, KEPT = 1 << 20, 10
#: Edges that a step works on at once, and transforms that the driver works on at once.
TILE, THREADS = 1 << 15, 4
#: What a record of a block is: its places, what it sends to another, what it got of one, its edges.
OWN, SEND, GOT, EDGE = range(4)
#: The curve 1 / (1 + a d^2b) for a least distance of 0.1.
CURVE_A, CURVE_B = 1.577, 0.8951


def _rows(neighbours: DataFrame) -> DataFrame:
    """``a, near``: each vector's own neighbours, nearest first."""
    return neighbours.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("rank", "b", "value"))).alias("near"))


def search_beta(far: np.ndarray, perplexity: float, steps: int = 64) -> np.ndarray:
    """Conditional probabilities of each row of squared distances, with the entropy of the perplexity (as near as the row allows)."""
    goal, beta = math.log(min(perplexity, far.shape[1])), np.ones(len(far))
    low, high = np.zeros(len(far)), np.full(len(far), np.inf)
    gap = far - far.min(1, keepdims=True)
    for _ in range(steps):
        e = np.exp(-gap * beta[:, None])
        total = e.sum(1)
        entropy = np.log(total) + beta * (gap * e).sum(1) / total
        broad = entropy > goal
        low, high = np.where(broad, beta, low), np.where(broad, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    e = np.exp(-gap * beta[:, None])
    return e / e.sum(1, keepdims=True)


def search_sigma(far: np.ndarray, steps: int = 64) -> np.ndarray:
    """Memberships exp(-(d - nearest) / sigma) of each row that sum to log2 of its length."""
    goal = math.log2(far.shape[1]) if far.shape[1] > 1 else 1.0
    gap = np.maximum(far - np.where(far > 0, far, np.inf).min(1, keepdims=True, initial=np.inf), 0.0)
    gap = np.where(np.isfinite(gap), gap, 0.0)
    sigma, low, high = np.ones(len(far)), np.zeros(len(far)), np.full(len(far), np.inf)
    for _ in range(steps):
        over = np.exp(-gap / sigma[:, None]).sum(1) > goal
        low, high = np.where(over, low, sigma), np.where(over, sigma, high)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    sigma = np.maximum(sigma, 1e-3 * far.mean(1))
    return np.exp(-gap / np.maximum(sigma, 1e-300)[:, None])


def _weighted(neighbours: DataFrame, weigh) -> DataFrame:
    """``i, j, w`` of each vector's own neighbours; rows of one length are worked out together."""

    def run(frames):
        for pdf in frames:
            for _, own in pdf.groupby(pdf["near"].map(len)):
                near = own["near"].to_list()
                w = weigh(np.array([[n["value"] for n in r] for r in near], dtype=np.float64))
                yield pd.DataFrame({"i": np.repeat(own["a"].to_numpy(), w.shape[1]), "j": [n["b"] for r in near for n in r], "w": w.ravel()})

    return _rows(neighbours).mapInPandas(run, "i long, j long, w double")


def affinities(neighbours: DataFrame, perplexity: float) -> DataFrame:
    """``i, j, p``: joint probabilities of t-SNE, both ways, all together 1."""
    one = _weighted(neighbours, lambda far: search_beta(far**2, perplexity))
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("w"))
    both = stored(both, "affinities")
    total = both.agg(F.sum("w")).first()[0] or 1.0
    return both.select("i", "j", (F.col("w") / total).alias("p"))


def memberships(neighbours: DataFrame) -> DataFrame:
    """``i, j, w``: UMAP's fuzzy union, w + w' - w w', both ways."""
    one = _weighted(neighbours, search_sigma)
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.sum("w").alias("s"), F.product("w").alias("m"), F.count(F.lit(1)).alias("n"))
    return both.select("i", "j", F.when(F.col("n") > 1, F.col("s") - F.col("m")).otherwise(F.col("s")).alias("w"))


def _noise(seed: int, *of: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / float(1 << 53)


def _start(ids: DataFrame, seed: int, size: float) -> DataFrame:
    """``i, y0, y1``: normal places by hash (Box and Muller)."""
    radius = lambda k: F.sqrt(-2 * F.ln(1 - _noise(seed + k, F.col("i"))))
    return ids.select("i", (size * radius(1) * F.cos(2 * math.pi * _noise(seed + 2, F.col("i")))).alias("y0"), (size * radius(3) * F.cos(2 * math.pi * _noise(seed + 4, F.col("i")))).alias("y1"))


class Grid:
    """Nodes over the places' extent; each place is tied to the 3 x 3 nodes around it by quadratic weights."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        extent = float((high - low).max())
        nodes = max(LEAST, min(FINE, math.ceil(extent / SPACING)), math.ceil(extent / COARSE))
        self.step = extent / min(NODES - 4, nodes) or SPACING
        self.low, self.n = low - 1.5 * self.step, int(np.ceil(extent / self.step)) + 4
        self.potential, self.total = None, 0.0

    def weights(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each axis the middle node of each place, and the weights of it and those beside it."""
        at = (y - self.low) / self.step
        mid = np.clip(np.rint(at).astype(np.int64), 1, self.n - 2)
        t = at - mid
        return mid, np.stack([t * (t - 1) / 2, 1 - t * t, t * (t + 1) / 2], axis=-1)

    def holds(self, low: np.ndarray, high: np.ndarray) -> bool:
        """Whether places up to ``low`` and ``high`` have nodes on all sides."""
        return bool((low >= self.low + 0.5 * self.step).all() and (high <= self.low + (self.n - 1.5) * self.step).all())

    def spread(self, y: np.ndarray) -> np.ndarray:
        """Charges 1, y0, y1 of the places on the nodes."""
        mid, w = self.weights(y)
        cell = np.concatenate([(mid[:, 0] + a - 1) * self.n + mid[:, 1] + b - 1 for a in range(3) for b in range(3)])
        part = np.stack([w[:, 0, a] * w[:, 1, b] for a in range(3) for b in range(3)])
        out = [np.bincount(cell, charge.ravel(), self.n * self.n) for charge in (part, part * y[:, 0], part * y[:, 1])]
        return np.stack(out).reshape(3, self.n, self.n)

    def solve(self, charges: np.ndarray) -> None:
        """Potentials of the kernels w (of charge 1) and w^2 (of all three), w = 1 / (1 + d^2); ``total`` is the sum of w over all pairs of two."""
        n = self.n
        size = min(f << k for f in (2, 3, 5) for k in range(12) if f << k >= 2 * n)  # lengths that are fast
        line = np.minimum(np.arange(size), size - np.arange(size)) * self.step
        w = 1 / (1 + line[:, None] ** 2 + line[None, :] ** 2)
        ahead = lambda x: np.fft.fft(np.fft.rfft(x, size, axis=1), size, axis=0)  # noqa: E731  rows of zeros are left out, here and in what is read back
        back = lambda x, kernel: np.fft.irfft(np.fft.ifft(x * kernel, axis=0)[:n], size, axis=1)[:, :n]
        with ThreadPoolExecutor(THREADS) as pool:
            *at, once, twice = pool.map(ahead, [*charges, w, w * w])
            self.potential = np.stack(list(pool.map(back, [at[0], *at], [once, twice, twice, twice])))
        self.total = float((charges[0] * self.potential[0]).sum() - charges[0].sum())

    def read(self, y: np.ndarray) -> np.ndarray:
        """The four potentials at the places."""
        mid, w = self.weights(y)
        out = np.zeros((4, len(y)))
        for a in range(3):
            for b in range(3):
                out += self.potential[:, mid[:, 0] + a - 1, mid[:, 1] + b - 1] * (w[:, 0, a] * w[:, 1, b])
        return out

    def repulsion(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the sum of w over the others, and of w^2 (y_i - y_j)."""
        z, p, x0, x1 = self.read(y)
        return z - 1, np.stack([y[:, 0] * p - x0, y[:, 1] * p - x1], axis=1)


def _grid(places: DataFrame) -> Grid:
    """The solved grid of the present places; tasks send their partial grids, which a tree of bounded arrays adds."""
    low0, high0, low1, high1 = places.agg(F.min("y0"), F.max("y0"), F.min("y1"), F.max("y1")).first()
    grid = Grid(np.array([low0, low1]), np.array([high0, high1]))

    def run(frames):
        total = np.zeros((3, grid.n, grid.n))
        for pdf in frames:
            total += grid.spread(pdf[["y0", "y1"]].to_numpy())
        yield pd.DataFrame({"c": [total.tobytes()]})

    add = lambda a, b: a + b
    parts = places.select("y0", "y1").mapInPandas(run, "c binary").rdd.map(lambda r: np.frombuffer(bytes(r[0])).reshape(3, grid.n, grid.n))
    grid.solve(parts.treeAggregate(np.zeros((3, grid.n, grid.n)), add, add))
    return grid


def _dealt(edges: DataFrame, ids: DataFrame, seed: int, blocks: int) -> DataFrame:
    """``block, kind, other, x, y, z``, arrays as bytes: each block's ids and first places, its edges (own row, place among what it gets, p), and the ids it asks of each block."""
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    left, right = _start(ids, seed, 1e-2).withColumn("block", of("i")), edges.select("i", "j", "p", of("i").alias("block"), of("j").alias("other"))
    names = ["block", "kind", "other", "x", "y", "z"]

    def deal(key, places: pa.Table, own: pa.Table) -> pa.Table:
        block, places = key[0].as_py(), places.sort_by("i")
        ids = places["i"].to_numpy()
        rows = [(block, OWN, 0, ids.tobytes(), np.stack([places["y0"].to_numpy(), places["y1"].to_numpy()], axis=1).tobytes(), b"")]
        i, j, p, other = (own[c].to_numpy() for c in ("i", "j", "p", "other"))
        order = np.lexsort((j, other))
        first = np.ones(len(j), dtype=bool)
        first[1:] = (j[order][1:] != j[order][:-1]) | (other[order][1:] != other[order][:-1])
        at = np.empty(len(j), dtype=np.int32)
        at[order] = np.cumsum(first) - 1
        asked, source = j[order][first], other[order][first]
        rows += [(int(s), SEND, block, asked[source == s].tobytes(), b"", b"") for s in np.unique(source)]
        row = np.searchsorted(ids, i).astype(np.int32)
        order = np.lexsort((at, row))
        row, at, p = row[order], at[order], p[order]
        rows += [(block, EDGE, k, *(c[k : k + EDGES].tobytes() for c in (row, at, p))) for k in range(0, len(p), EDGES)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] * 3 + [pa.binary()] * 3)], names=names)

    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(deal, "block int, kind int, other int, x binary, y binary, z binary")


def _arranged(records):
    """What is asked of a block by id becomes rows of it; the ids stay with what they name."""
    records = list(records)
    ids = {block: x[0] for block, (kind, _, *x) in records if kind == OWN}
    for block, (kind, other, *x) in records:
        if kind == SEND:
            yield block, (SEND, other, np.searchsorted(ids[block], x[0]).astype(np.int32))


def _sent(records):
    """The places that blocks ask for, in single precision; a block's own record comes before what it sends."""
    own = {}
    for block, (kind, other, *x) in records:
        if kind == OWN:
            own[block] = x[0].astype(np.float32)
        else:
            yield other, (GOT, block, own[block][x[0]])


def _moved(held):
    """Places, speeds and gains after a step: records of places come first, then what was sent, then the edges."""

    def run(records):
        grid, more, momentum, rate, divergence = held.value
        own, got, there, here, pull, logs = {}, {}, {}, {}, {}, {}
        for block, (kind, other, *x) in records:
            if kind == OWN:
                own[block], here[block], pull[block], logs[block] = x, np.ascontiguousarray(x[0].T), np.zeros((2, len(x[0]))), 0.0
            elif kind == GOT:
                got.setdefault(block, {})[other] = x[0]
            else:
                if block not in there:
                    some = got.pop(block)
                    there[block] = np.ascontiguousarray(np.concatenate([some[s] for s in sorted(some)]).T, dtype=np.float64)
                for first in range(0, len(x[0]), TILE):  # rows are in order, so a tile adds to few
                    row, at, p = (c[first : first + TILE] for c in x)
                    gap = [here[block][k].take(row) for k in range(2)]
                    for k in range(2):
                        gap[k] -= there[block][k].take(at)
                    q = gap[0] * gap[0]
                    q += gap[1] * gap[1]
                    q += 1
                    if divergence:
                        logs[block] += float((p * np.log(q)).sum())
                    np.divide(p, q, out=q)
                    low, high = int(row[0]), int(row[-1]) + 1
                    for k in range(2):
                        pull[block][k, low:high] += np.bincount(row - low, q * gap[k], high - low)
        for block, (y, v, g) in own.items():
            slope = 4 * (more * pull[block].T - grid.repulsion(y)[1] / max(grid.total, 1e-300))
            gain = np.maximum(0.01, np.where(slope * v < 0, g + 0.2, g * 0.8))
            speed = momentum * v - rate * gain * slope
            yield block, (OWN, logs[block], y + speed, speed, gain)

    return run


def _record(row):
    kinds = {OWN: ("int64", "float64"), SEND: ("int64",), EDGE: ("int32", "int32", "float64")}[row.kind]
    return row.block, (row.kind, row.other, *(np.frombuffer(bytes(x), t) for x, t in zip((row.x, row.y, row.z), kinds)))


def _same(records):
    return iter(records)


def _first(records):
    """Places before the first step, with no speed and gains of 1."""
    for block, (_, _, _, y) in records:
        y = y.reshape(-1, 2)
        yield block, (OWN, 0.0, y, np.zeros_like(y), np.ones_like(y))


def _listed(records):
    """``i, y0, y1``: the places come before the names."""
    own = {}
    for block, (_, _, x, y, *more) in records:
        if more:
            own[block] = x
        else:
            yield from ((i, *p) for i, p in zip(x.tolist(), own[block].tolist()))


def _charged(grid: Grid | None):
    """Of a partition: extent, sum of logarithms, and, where a grid that was chosen before holds the places, the charges on it or the places, whichever is less."""

    def run(records):
        own = sorted((block, x[1], x[2]) for block, x in records)
        if own:
            y = np.concatenate([x[2] for x in own])
            low, high = y.min(0), y.max(0)
            fits = grid is not None and grid.holds(low, high)
            yield low, high, sum(x[1] for x in own), (y if y.size < 3 * grid.n**2 else grid.spread(y)) if fits else None

    return run


def _survey(places: RDD, grid: Grid | None, reach: float) -> tuple[Grid, np.ndarray, np.ndarray, float]:
    """The solved grid of the present places, their extent and the sum of logarithms; a grid that fits is made where ``grid`` doesn't, ``reach`` wider."""
    while True:
        parts = places.mapPartitions(_charged(grid)).collect()  # an array of the grid's size at most from each task
        low, high = np.min([p[0] for p in parts], axis=0), np.max([p[1] for p in parts], axis=0)
        if all(p[3] is not None for p in parts):
            few, charges = [p[3] for p in parts if p[3].ndim == 2], [p[3] for p in parts if p[3].ndim == 3]
            grid.solve(sum(charges + [grid.spread(y) for y in few]))
            return grid, low, high, sum(p[2] for p in parts)
        grid = Grid(low - reach, high + reach)


def tsne(edges: DataFrame, ids: DataFrame, steps: int = 60, early: int = 20, exaggeration: float = 12.0, rate: float | None = None, seed: int = 1, history: list | None = None) -> DataFrame:
    """``i, y0, y1`` from ``affinities`` (stored) and ``ids(i)``; ``history`` collects the divergence of each step."""
    spark, context = ids.sparkSession, ids.sparkSession.sparkContext
    known = stored(ids.select("i").distinct(), "ids")
    n = known.count()
    if n < 2:
        return _start(ids, seed, 1e-2)
    blocks = max(-(-n // WIDE), min(SIDES, -(-n // NARROW)))
    parts = max(1, min(blocks, context.defaultParallelism))
    rate = max(n / exaggeration / 4, 10.0) if rate is None else rate
    entropy = (edges.agg(F.sum(F.col("p") * F.ln("p"))).first()[0] or 0.0) if history is not None else 0.0
    dealt = stored(_dealt(edges, known, seed, blocks), "dealt")

    def records(kinds: list[int], make) -> RDD:
        rows = dealt.where(F.col("kind").isin(kinds)).rdd.map(_record).partitionBy(parts)
        return rows.mapPartitions(make, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)

    asked, links, places, names = records([OWN, SEND], _arranged), records([EDGE], _same), records([OWN], _first), records([OWN], _same)
    grid, low, high, _ = _survey(places, None, 0.0)
    sent, written = [], None
    for t in range(steps):
        more, momentum = (exaggeration, 0.5) if t < early else (1.0, 0.8)
        total = grid.total
        sent.append(context.broadcast((grid, more, momentum, rate, history is not None)))
        got = context.union([places, asked]).mapPartitions(_sent).partitionBy(parts)
        moved = context.union([places, got, links]).mapPartitions(_moved(sent[-1]), preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
        if t % KEPT == KEPT - 1:
            moved.checkpoint()
        margin = 1.5 * max(np.abs(low - before[0]).max(), np.abs(high - before[1]).max()) + 0.02 * (high - low).max() if t else 0.5 * (high - low).max()
        before = low, high
        grid, low, high, log = _survey(moved, Grid(low - margin, high + margin), margin)
        if history is not None:
            history.append(entropy + log + math.log(max(total, 1e-300)))
        places.unpersist()
        places = moved
        if t % KEPT == KEPT - 1:
            got.cleanShuffleDependencies()  # what was sent before the checkpoint
            for one in sent[:-1]:  # the last one still belongs to the places
                one.destroy()
            if written:
                deleted(spark, written)
            sent, written = sent[-1:], deleted_on_exit(spark, moved.getCheckpointFile())
    made = spark.createDataFrame(context.union([places, names]).mapPartitions(_listed), "i long, y0 double, y1 double", verifySchema=False)
    made = stored(made, "places")
    for one in (asked, links, places, names):
        one.unpersist()
    for one in sent:
        one.destroy()
    return ids.join(made, "i", "left").select("i", "y0", "y1")


def umap(edges: DataFrame, ids: DataFrame, epochs: int = 40, negatives: int = 5, rate: float = 1.0, seed: int = 1) -> DataFrame:
    """``i, y0, y1`` from ``memberships`` (stored) and ``ids(i)``.

    An edge is drawn in an epoch with a probability of its weight over the largest one, by hash; ``negatives`` vertices are drawn for each, by
    number. All moves of an epoch start from the same places and are added up, each held within 4.
    """
    places = stored(numbered(_start(ids, seed, 5.0), [], [F.col("i")], "at"), "places")
    n = places.count()
    most = edges.agg(F.max("w")).first()[0]
    if n < 2 or not most:
        return places.select("i", "y0", "y1")
    held = lambda x: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), x))
    for t in range(epochs):
        alpha = rate * (1 - t / epochs)
        there = places.select(F.col("i").alias("j"), F.col("y0").alias("x0"), F.col("y1").alias("x1"))
        drawn = edges.where(_noise(seed * 1000 + t, F.least("i", "j"), F.greatest("i", "j")) < F.col("w") / most)
        met = drawn.join(there, "j").join(places.drop("at"), "i")
        d0, d1 = F.col("y0") - F.col("x0"), F.col("y1") - F.col("x1")
        far = d0 * d0 + d1 * d1
        pull = F.when(far > 0, -2 * CURVE_A * CURVE_B * F.pow(far, CURVE_B - 1) / (1 + CURVE_A * F.pow(far, CURVE_B))).otherwise(F.lit(0.0))
        near = met.select("i", held(pull * d0).alias("m0"), held(pull * d1).alias("m1"))
        other = F.explode(F.transform(F.sequence(F.lit(1), F.lit(negatives)), lambda k: F.floor(_noise(seed * 1000 + t, F.col("i"), F.col("j"), k) * n).cast("long") + 1)).alias("at")
        asked = drawn.select("i", "j", other).join(places.select("at", F.col("i").alias("o"), F.col("y0").alias("x0"), F.col("y1").alias("x1")), "at").where("o <> i").join(places.drop("at"), "i")
        push = 2 * CURVE_B / ((0.001 + far) * (1 + CURVE_A * F.pow(far, CURVE_B)))
        away = asked.select("i", held(push * d0).alias("m0"), held(push * d1).alias("m1"))
        moves = near.unionByName(away).groupBy("i").agg(F.sum("m0").alias("m0"), F.sum("m1").alias("m1"))
        step = lambda k: (F.col(f"y{k}") + alpha * held(F.coalesce(f"m{k}", F.lit(0.0)))).alias(f"y{k}")
        places = stored(places.join(moves, "i", "left").select("i", "at", step(0), step(1)), "places")
    return places.select("i", "y0", "y1")


def neighbour_graph(vectors: DataFrame, k: int, by_cosine: bool = False) -> DataFrame:
    """``a, b, value, rank`` of the k nearest; by cosine, the distance is 1 - cosine of unit vectors, half their squared distance."""
    if not by_cosine:
        return stored(nearest(vectors, k), "graph")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = vectors.select("vec_id", norm.alias("_norm"), "v").select("vec_id", F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.col("_norm")), F.lit(0.0))).alias("v"))
    return stored(nearest(unit, k).withColumn("value", F.col("value") * F.col("value") / 2), "graph")


def trustworthiness(vectors: DataFrame, places: DataFrame, k: int) -> float:
    """1 less the penalty for neighbours on the map that aren't among the k nearest, by how far down they come (ranks to 2k counted, more as 2k)."""
    n = places.count()
    flat = nearest(places.select(F.col("i").alias("vec_id"), F.array("y0", "y1").alias("v")), k).select("a", "b")
    real = nearest(vectors, 2 * k).select("a", "b", F.col("rank").alias("r"))
    lost = flat.join(real, ["a", "b"], "left").select(F.greatest(F.lit(0), F.coalesce("r", F.lit(2 * k)) - k).alias("down")).agg(F.sum("down")).first()[0] or 0
    return 1 - lost / (n * k * k)
