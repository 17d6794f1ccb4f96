"""Embedding-space experiments: scaling, principal components, deterministic noise dimensions, clusters."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def _moments(vectors: DataFrame) -> DataFrame:
    e = vectors.select("vec_id", F.posexplode("v").alias("dim", "x"))
    return e.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))  # a row for each dimension


def standard_scale(vectors: DataFrame) -> DataFrame:
    """Zero mean and unit population deviation by dimension; constants become 0."""
    stats = _moments(vectors).agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "sd"))).alias("stats"))
    z = F.zip_with("v", "stats", lambda x, s: F.when(s["sd"] == 0, F.lit(0.0)).otherwise(F.try_divide(x - s["mean"], s["sd"])))
    return vectors.crossJoin(F.broadcast(stats)).select(*[c for c in vectors.columns if c != "v"], z.alias("v"))


def gram(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, centred scatter matrix and count: partial sums by task, dimensions squared on the driver."""
    from pyspark.sql import types as T

    def run(frames):
        n, total, outer = 0, None, None
        for pdf in frames:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                total, outer, n = (x.sum(0), x.T @ x, len(x)) if total is None else (total + x.sum(0), outer + x.T @ x, n + len(x))
        if n:
            import pandas as pd

            yield pd.DataFrame({"n": [n], "total": [total.tolist()], "outer": [outer.ravel().tolist()]})

    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType())), T.StructField("outer", T.ArrayType(T.DoubleType()))])
    e = vectors.select("v").mapInPandas(run, schema)
    add = lambda c: e.select(F.posexplode(c).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).agg(F.sort_array(F.collect_list(F.struct("i", "x")))).first()[0]
    n = e.agg(F.sum("n")).first()[0]
    total = np.array([r["x"] for r in add("total")])
    outer = np.array([r["x"] for r in add("outer")]).reshape(len(total), len(total))
    mean = total / n
    return mean, outer - n * np.outer(mean, mean), n


@dataclass
class Principal:
    """The leading components of a table of vectors: ``axes`` (a row each, largest loading positive), standard deviations along them, shares of variance."""

    mean: np.ndarray
    axes: np.ndarray
    deviations: np.ndarray
    shares: np.ndarray

    def project(self, vectors: DataFrame) -> DataFrame:
        """``v`` centred and projected; other columns stay. Any vectors of these dimensions, such as queries, go through the same fit."""
        centred = F.zip_with("v", F.array(*[F.lit(float(m)) for m in self.mean]), lambda x, m: x - m)
        dot = lambda axis: F.aggregate(F.zip_with("_centred", F.array(*[F.lit(float(a)) for a in axis]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x)
        rest = [c for c in vectors.columns if c != "v"]
        return vectors.select(*rest, F.explode(F.array(centred)).alias("_centred")).select(*rest, F.array(*[dot(a) for a in self.axes]).alias("v"))


def principal(vectors: DataFrame, k: int) -> Principal:
    """From the scatter matrix, which is all that reaches the driver; deviations divide by n - 1."""
    mean, scatter, n = gram(vectors)
    values, axes = np.linalg.eigh(scatter)
    order = np.argsort(values)[::-1][:k]
    axes = axes[:, order].T
    axes = axes * np.sign(axes[np.arange(len(order)), np.abs(axes).argmax(1)])[:, None]
    values, total = np.maximum(values, 0.0), max(float(values.sum()), np.finfo(float).tiny)
    return Principal(mean, axes, np.sqrt(values[order] / max(1, n - 1)), values[order] / total)


def pca(vectors: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """Centred projections on the first ``k`` components and their shares of variance."""
    made = principal(vectors, k)
    return made.project(vectors), made.shares


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Draws that are worked on at once.
DRAWS = 1 << 15


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    out = x << np.uint64(by)
    x >>= np.uint64(64 - by)
    out |= x
    return out


def _ended(h: np.ndarray) -> np.ndarray:
    for by, times in ((33, _P2), (29, _P3), (32, None)):
        h ^= h >> np.uint64(by)
        if times is not None:
            h *= times
    return h


def hash_ints(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """``xxhash64`` of 32-bit integers, as Spark works it out, on top of the hash ``seed`` of what stands before them."""
    h = _turned((seed + (_P5 + np.uint64(4))) ^ (x.astype(np.uint32).astype(np.uint64) * _P1), 23)
    h *= _P2
    h += _P3
    return _ended(h)


def hash_longs(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    h = _turned((seed + (_P5 + np.uint64(8))) ^ (_turned(x.astype(np.int64).view(np.uint64) * _P2, 31) * _P1), 27)
    h *= _P1
    h += _P4
    return _ended(h)


def hash_text(text: str, seed: int = 42) -> np.ndarray:
    """``xxhash64`` of a text, with Spark's seed, as an array of one."""
    data, full, (p1, p2, p3, p4, p5) = text.encode(), (1 << 64) - 1, (int(p) for p in (_P1, _P2, _P3, _P4, _P5))
    turned = lambda x, by: (x << by | x >> 64 - by) & full
    round_ = lambda h, x: turned((h + x * p2) & full, 31) * p1 & full
    eight = lambda at: int.from_bytes(data[at : at + 8], "little")
    at, n = 0, len(data)
    if n >= 32:
        v = [(seed + p1 + p2) & full, (seed + p2) & full, seed, (seed - p1) & full]
        while at <= n - 32:
            v = [round_(h, eight(at + 8 * k)) for k, h in enumerate(v)]
            at += 32
        h = sum(turned(x, by) for x, by in zip(v, (1, 7, 12, 18))) & full
        for x in v:
            h = ((h ^ round_(0, x)) * p1 + p4) & full
    else:
        h = (seed + p5) & full
    h = (h + n) & full
    while at <= n - 8:
        h = (turned(h ^ round_(0, eight(at)), 27) * p1 + p4) & full
        at += 8
    if at <= n - 4:
        h = (turned(h ^ int.from_bytes(data[at : at + 4], "little") * p1 & full, 23) * p2 + p3) & full
        at += 4
    for x in data[at:]:
        h = turned(h ^ x * p5 & full, 11) * p1 & full
    return _ended(np.array([h], dtype=np.uint64))


class Noise:
    """Independent draws for the dimensions ``i`` of some vectors: a row each, from ``xxhash64(seed, vec_id, i)``, so the same on every run and however rows are dealt.

    ``row`` has the vectors' own statistics, a column each (NaN where there is none).
    """

    def __init__(self, seed: str, i: np.ndarray, ids: np.ndarray, row: dict[str, np.ndarray]):
        self.seed, self.i, self.ids, self.row, self.n = seed, i, ids, row, 0

    def _key(self) -> str:
        self.n += 1
        return f"{self.seed}/{self.n}"

    def uniform(self, key: str) -> np.ndarray:
        """In (0, 1)."""
        own = hash_text(key)
        h = hash_ints(self.i[None, :], (hash_ints if self.ids.dtype == np.int32 else hash_longs)(self.ids, own)[:, None])
        h &= np.uint64((1 << 52) - 1)
        out = h.astype(np.float64)
        out += 0.5
        out /= float(1 << 52)
        return out

    def normal(self, key: str) -> np.ndarray:
        out = np.log(self.uniform(key + "/r"))
        out *= -2
        np.sqrt(out, out=out)
        turn = self.uniform(key + "/a")
        turn *= 2 * math.pi
        out *= np.cos(turn, out=turn)
        return out

    def flat(self, half, middle=0.0) -> np.ndarray:
        out = self.uniform(self._key())
        out *= 2
        out -= 1
        out *= half
        out += middle
        return out

    def between(self, low, high) -> np.ndarray:
        return low + (high - low) * self.uniform(self._key())

    def bell(self, middle, sd) -> np.ndarray:
        return middle + sd * self.normal(self._key())

    def double(self, scale) -> np.ndarray:
        """Exponential with either sign."""
        key = self._key()
        sign = np.where(self.uniform(key + "/sign") < 0.5, -1.0, 1.0)
        return -sign * scale * np.log(self.uniform(key))

    def beside(self, column: str, k: int, half, weight) -> np.ndarray:
        """A draw for each of ``k`` neighbours, weighed by ``weight(similarity)``; 0 for one that isn't there."""
        out = 0.0
        for j in range(k):
            near = weight(self.row[column][:, j : j + 1])
            out = out + self.flat(half) * np.where(np.isnan(near), 0.0, near)
        return out


def _row(x: Noise):
    return x.row["_mean"], x.row["_sd"], x.row["_least"], x.row["_most"]


def _uniform(x: Noise, s: float) -> np.ndarray:
    mean, sd, _, _ = _row(x)
    return x.flat(s * sd, mean)


def _gaussian(x: Noise, s: float) -> np.ndarray:
    mean, sd, _, _ = _row(x)
    return x.bell(mean, s * sd)


def _wide(x: Noise, s: float) -> np.ndarray:
    return x.flat(s) + x.flat(0.5 * _row(x)[1]) + x.flat(0.5 * s)


def _bells(x: Noise, s: float) -> np.ndarray:
    mean, sd, _, _ = _row(x)
    return x.bell(0.0, s) + x.bell(0.1 * mean, 0.2 * sd) + x.bell(0.0, 0.8 * s)


def _own(spread: float, feature: tuple[float, float], extra: float, reach: float = 0.0):
    """Around a scale that grows with the vector's own deviation; its mean and deviation, and its range, show through."""

    def made(x: Noise, s: float) -> np.ndarray:
        mean, sd, least, most = _row(x)
        out = x.flat(s * (1 + spread * sd)) + x.bell(feature[0] * mean, feature[1] * sd) + x.flat(extra * s)
        return out + x.between(reach * least, reach * most) if reach else out

    return made


def _beside(base: float, half: float, weight: float, k: int = 3, far: tuple[float, float] | None = None, more=None):
    """The closer a neighbour, the more noise sets the vector apart from it; far vectors add to it the less alike they are."""

    def made(x: Noise, s: float) -> np.ndarray:
        out = x.flat(base * s) + x.beside("_near", k, half * s, lambda sim: weight * sim)
        if far is not None:
            out = out + x.beside("_far", 3, far[0] * s, lambda sim: far[1] * (1 - sim))
        return out if more is None else out + more(x, s)

    return made


def _ranked(x: Noise, s: float) -> np.ndarray:
    return x.flat(s) + sum((0.3 * (j + 1) * x.flat(0.5 * s) for j in range(3)), 0.0)


def _cluster(x: Noise, s: float) -> np.ndarray:
    """A draw for each other member of the cluster; their sum is drawn at once, as a normal of the same variance."""
    members = x.row["_members"]
    inside = x.bell(0.0, 0.2 * 0.3 * s * np.sqrt(np.maximum(members - 1, 0) / 3.0))
    return x.flat(s * (1 + 0.1 * members)) + inside + sum((0.1 * x.flat(0.2 * s) for _ in range(3)), 0.0)


def _steps(first: float, step: float, n: int):
    return [lambda x, s, k=k: x.flat(s * (first + step * k)) for k in range(n)]


def _scales(*own: float):
    mean = lambda x: x.bell(0.02 * x.row["_mean"], 0.01)
    return [lambda x, s, c=c, k=k: x.flat(c * s) + (mean(x) if k else 0.0) for k, c in enumerate(own)]


_extra = lambda x, s: x.bell(0.0, 0.3 * s) + x.bell(0.03 * x.row["_mean"], 0.05 * x.row["_sd"])
_content = lambda x, s: x.bell(0.03 * x.row["_mean"], 0.08 * x.row["_sd"]) + x.between(0.02 * x.row["_least"], 0.02 * x.row["_most"]) + x.flat(0.3 * s * x.row["_sd"])
#: Families as (configurations of dimensions and scale; kernels of equal sections, one after another; what the mean so far adds).
FAMILIES = {
    "uniform": ([(100, 0.3), (150, 0.4), (200, 0.5)], [_uniform], 0.0),
    "gaussian": ([(100, 0.25), (150, 0.35), (200, 0.45)], [_gaussian], 0.0),
    "mixed": ([(150, 0.3), (200, 0.4)], [_uniform, _gaussian], 0.0),
    "extreme_uniform": ([(500, 0.8), (1000, 1.0)], [_wide], 0.0),
    "extreme_gaussian": ([(500, 0.7), (1000, 0.9)], [_bells], 0.0),
    "extreme_hybrid": ([(750, 0.8)], [lambda x, s: _wide(x, 1.2 * s), lambda x, s: _bells(x, 1.1 * s), lambda x, s: x.double(s)], 0.0),
    "extreme_cluster": ([(600, 0.9)], [_ranked], 0.0),
    "extreme_sequential": ([(800, 0.85)], [_wide, lambda x, s: _bells(x, 1.1 * s), lambda x, s: x.double(0.8 * s), lambda x, s: x.flat(1.5 * s)], 0.0),
    "extreme_adaptive": ([(900, 0.95)], [_own(0.5, (0.1, 0.3), 0.6, 0.1)], 0.0),
    "ultra_semantic": ([(300, 0.3)], [_beside(0.5, 0.3, 0.5)], 0.0),
    "ultra_progressive": ([(400, 0.4)], _steps(0.5, 0.2, 4), 0.1),
    "ultra_document": ([(500, 0.5)], [_own(0.3, (0.05, 0.1), 0.3, 0.05)], 0.0),
    "ultra_balance": ([(600, 0.6)], [_beside(0.6, 0.4, 0.3, far=(0.2, 0.2))], 0.0),
    "ultra_cluster": ([(700, 0.7)], [_cluster], 0.0),
    "ultra_sequential": ([(800, 0.8)], _scales(0.3, 0.5, 0.7, 0.9, 0.6), 0.0),
    "ultra_hybrid": ([(900, 0.9)], [lambda x, s: x.flat(0.6 * s), lambda x, s: x.bell(0.0, 0.5 * s), lambda x, s: x.double(0.4 * s), lambda x, s: x.flat(0.8 * s) * (1 + 0.2 * x.row["_sd"])], 0.0),
    "ultra_max": ([(1000, 1.0)], [_beside(1.0, 1.2, 0.8, k=5, more=_extra)], 0.0),
    "final_similarity": ([(200, 0.1)], [_beside(0.3, 0.4, 0.6)], 0.0),
    "final_fingerprint": ([(300, 0.15)], [_own(0.2, (0.02, 0.05), 0.5)], 0.0),
    "final_progressive": ([(400, 0.2)], _steps(0.3, 0.15, 5), 0.05),
    "final_balance": ([(500, 0.25)], [_beside(0.4, 0.5, 0.4, far=(0.2, 0.3))], 0.0),
    "final_content": ([(600, 0.3)], [_beside(1.0, 0.6, 0.5, more=_content)], 0.0),
}
CLUSTERS = 5


def _plain(c: float):
    return lambda x, s: x.flat(c * s)


_bell = lambda x, s: x.bell(0.0, s)
_double = lambda x, s: x.double(s)
_times = lambda kernel, c: lambda x, s: kernel(x, c * s)
#: What each family draws for a query, in equal sections; nothing of it follows other vectors or sections.
QUERY_KERNELS = {
    "uniform": [_uniform], "gaussian": [_gaussian], "mixed": [_uniform, _gaussian],
    "extreme_uniform": [_plain(1.0)], "extreme_gaussian": [_bell], "extreme_hybrid": [_plain(1.2), _times(_bell, 1.1), _double], "extreme_cluster": [_plain(1.0)],
    "extreme_sequential": [_plain(1.0), _times(_bell, 1.1), _times(_double, 0.8), _plain(1.5)], "extreme_adaptive": [_plain(1.5)],
    "ultra_semantic": [_plain(0.5)], "ultra_progressive": [_plain(0.6)], "ultra_document": [_plain(0.7)], "ultra_balance": [_plain(0.6)],
    "ultra_cluster": [_plain(0.8)], "ultra_sequential": [_plain(0.7)], "ultra_hybrid": [_plain(0.8)], "ultra_max": [_plain(0.9)],
    "final_similarity": [_plain(0.3)], "final_fingerprint": [_plain(0.5)], "final_progressive": [_plain(0.6)], "final_balance": [_plain(0.4)], "final_content": [_plain(0.7)],
}


def described(vectors: DataFrame, neighbours: bool = True) -> DataFrame:
    """``vectors`` with what the kernels read: ``_mean, _sd, _least, _most``, cosines ``_near`` and ``_far``, and ``_members`` of the cluster."""
    from .pairwise import extremes

    n = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n
    sd = F.sqrt(F.greatest(F.lit(0.0), F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) / n - mean * mean))
    out = vectors.withColumns({"_mean": mean, "_sd": sd, "_least": F.array_min("v"), "_most": F.array_max("v")})
    if neighbours:
        out = out.join(extremes(vectors, 5), "vec_id", "left")
        groups = kmeans(vectors, max(1, min(CLUSTERS, vectors.count() // 3)))
        sizes = F.broadcast(groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("_members")))  # at most CLUSTERS rows
        return out.join(groups.join(sizes, "cluster").drop("cluster"), "vec_id", "left")
    nothing = F.array().cast("array<double>")
    return out.withColumns({"_near": nothing, "_far": nothing, "_members": F.lit(1)})


#: Statistics of a vector that kernels read, and how many neighbours of each kind.
STATISTICS, NEIGHBOURS = ("_mean", "_sd", "_least", "_most", "_members"), {"_near": 5, "_far": 5}


def _read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The statistics of ``described`` rows, a column each; NaN where there is none."""
    row = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None] for c in STATISTICS}
    for c, k in NEIGHBOURS.items():
        col = batch.column(c)
        size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, to = np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        row[c] = np.full((len(size), k), np.nan)
        row[c][at[to < k], to[to < k]] = col.flatten().to_numpy(zero_copy_only=False)[to < k]
    return row


def noise(family: str, dims: int, scale: float, side: str = "doc") -> Callable[[pa.RecordBatch], np.ndarray]:
    """What makes the family's noise of ``described`` rows: a row of ``dims`` for each."""
    _, kernels, carry = FAMILIES[family] if side == "doc" else (None, QUERY_KERNELS[family], 0.0)
    each = dims // len(kernels)
    edges = [*(k * each for k in range(len(kernels))), dims]

    def made(batch: pa.RecordBatch) -> np.ndarray:
        ids, row, out = batch.column("vec_id").to_numpy(), _read(batch), np.empty((batch.num_rows, dims))
        step = max(1, DRAWS // max(1, dims))
        for at in range(0, len(ids), step):
            own, some = slice(at, at + step), {c: x[at : at + step] for c, x in row.items()}
            for k, (kernel, first, last) in enumerate(zip(kernels, edges, edges[1:])):
                out[own, first:last] = kernel(Noise(f"{side}:{family}:{dims}:{k}", np.arange(first, last, dtype=np.int32), ids[own], some), scale)
                if k and carry:
                    out[own, first:last] += carry * np.cumsum(out[own, :first], axis=1)[:, -1:] / first
        return out

    return made


def expanded(batch: pa.RecordBatch, draw: Callable[[pa.RecordBatch], np.ndarray]) -> pa.Array:
    """The vectors of a batch, each with its noise after it; null where there is no vector, and noise that follows a statistic that isn't known is null."""
    v, drawn = batch.column("v"), draw(batch)
    n, dims = drawn.shape
    size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten()
    unknown = np.logical_or.reduce([pc.is_null(batch.column(c)).to_numpy(zero_copy_only=False) for c in STATISTICS])
    if n and not v.null_count and not flat.null_count and not unknown.any() and (size == size[0]).all():
        values = pa.array(np.concatenate([flat.to_numpy().reshape(n, -1), drawn], axis=1).ravel())
    else:
        first, own = np.cumsum(size) - size, size + dims
        start = np.cumsum(own) - own
        at = np.arange(own.sum()) - np.repeat(start, own)  # place in its own vector
        before = at < np.repeat(size, own)
        take = np.where(before, np.repeat(first, own) + at, len(flat) + np.repeat(np.arange(n) * dims - size, own) + at)
        values = pa.concat_arrays([flat, pa.array(drawn.ravel(), mask=(np.isnan(drawn) & unknown[:, None]).ravel())]).take(pa.array(take))
    offsets = np.concatenate([[0], np.cumsum(size + dims)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pc.is_null(v) if v.null_count else None)


def expand(rows: DataFrame, family: str, dims: int, scale: float, side: str = "doc", keep: list[str] = ()) -> DataFrame:
    """``described`` vectors with ``dims`` more dimensions of the family's noise, from hashes: ``vec_id, label, keep..., v``; queries (``side``) have kernels of their own."""
    draw, names = noise(family, dims, scale, side), ["vec_id", "label", *keep]
    step = max(1, 64 * DRAWS // max(1, dims))

    def run(frames):
        for b in frames:
            for at in range(0, b.num_rows, step):
                some = b.slice(at, step)
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in names), expanded(some, draw)], [*names, "v"])

    out = StructType([*(rows.schema[c] for c in names), StructField("v", ArrayType(DoubleType()))])
    return rows.select(*dict.fromkeys([*names, "v", *STATISTICS, *NEIGHBOURS])).mapInArrow(run, out)


def kmeans(vectors: DataFrame, k: int, seed: int = 42, iterations: int = 20) -> DataFrame:
    """``vec_id, cluster`` by MLlib's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", array_to_vector("v").alias("features"))
    return KMeans(k=k, seed=seed, maxIter=iterations).fit(rows).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))
