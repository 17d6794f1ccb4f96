"""All pairs of vectors by blocks: each pair of blocks is one matrix product in one task.

Vectors are dealt to blocks of a few thousand; a block pair (i <= j) is a group of bounded size, so a task's memory
doesn't grow with the table. Comparing all pairs stays quadratic; nearest neighbours and sums are
reduced inside each block pair before anything is exchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a product, and the most (in products) of an exchanged block; a table is dealt to this many blocks where that suffices.
BLOCK, WIDE, SIDES = 2048, 32, 8
#: Rows of a product that sums and extremes are taken of at once, while they are in the cache.
ROWS = 256


def _block_pairs(vectors: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Each vector travels once for each exchanged block; inside a task a pair of blocks is taken in products of ``block`` a side (``_tiles``)."""
    count = vectors.count()
    n = max(1, min(SIDES, -(-count // block)), -(-count // (WIDE * block)))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    dealt = vectors.select("vec_id", *columns, own.alias("_own")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return dealt.select("vec_id", *columns, "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))


def _products(pdf: pd.DataFrame, block: int):
    """``pdf`` sorted by id, then the places of the rows of both sides of each product of a block pair: of a block with itself those above and on the diagonal."""
    i, j = pdf["_i"].iloc[0], pdf["_j"].iloc[0]
    pdf = pdf.sort_values("vec_id", ignore_index=True)
    cut = lambda side: [side[at : at + block] for at in range(0, len(side), block)]
    own = pdf["_own"].to_numpy()
    lefts, rights = (cut(np.flatnonzero(own == side)) for side in (i, j))
    return pdf, [(left, right, i == j and a == b) for a, left in enumerate(lefts) for b, right in enumerate(rights) if i != j or b >= a]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1))[:, None]
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _tiles(pdf: pd.DataFrame, block: int):
    """``left, right, cosine, distance, same`` of each product of a block pair, sides sorted by id."""
    pdf, products = _products(pdf, block)
    for at, to, same in products:
        left, right = (pdf.iloc[side].reset_index(drop=True) for side in (at, to))
        x, y = _matrix(left["v"]), _matrix(right["v"])
        dots, nx, ny = x @ y.T, (x * x).sum(1), (y * y).sum(1)
        size = np.sqrt(nx[:, None] * ny[None, :])
        cosine = np.divide(dots, size, out=np.zeros_like(dots), where=size > 0)
        yield left, right, cosine, np.sqrt(np.maximum(nx[:, None] + ny[None, :] - 2 * dots, 0.0)), same


def nearest(vectors: DataFrame, k: int, farthest: bool = False, block: int = BLOCK) -> DataFrame:
    """``a, b, value, rank``: the k nearest (or farthest) others by Euclidean distance, ties by id."""
    from .ranking import top_k

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for left, right, _, far, same in _tiles(pdf, block):
            a, b = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
            for own, other, d in [(a, b, far)] if same else [(a, b, far), (b, a, far.T)]:
                order = np.round(-d if farthest else d, 6)
                order[own[:, None] == other[None, :]] = np.inf
                for row in range(len(own)):
                    best = np.lexsort((other, order[row]))[:k]
                    best = best[np.isfinite(order[row][best])]
                    out.append(pd.DataFrame({"a": own[row], "b": other[best], "value": d[row][best]}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "value": pd.Series([], dtype="float64")})

    found = _block_pairs(vectors, ["v"], block).groupBy("_i", "_j").applyInPandas(run, "a long, b long, value double")
    return top_k(found, k, ["a"], "value", ["b"], descending=farthest)


def separation(vectors: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """One row about all distances between different vectors, and how their cosines go with those of ``original``."""
    spread_all = vectors.select(F.explode("v").alias("x")).agg(F.var_pop("x").alias("_var"))
    m = moments(vectors, vectors if original is None else original).crossJoin(spread_all)  # one row each
    n = F.col("n")
    mean, var = F.col("d") / n, F.greatest(F.lit(0.0), F.col("dd") / n - (F.col("d") / n) * (F.col("d") / n))
    cosine, std = F.col("c") / n, F.sqrt(var)
    cov = F.col("co") / n - F.col("c") / n * F.col("o") / n
    spread = F.sqrt((F.col("cc") / n - cosine * cosine) * (F.col("oo") / n - (F.col("o") / n) * (F.col("o") / n)))
    return m.select(
        mean.alias("mean"), F.col("least"), F.col("most"), std.alias("std"), F.try_divide(var, F.col("_var")).alias("variance_ratio"), F.try_divide(F.col("least"), mean).alias("least_mean"),
        F.try_divide(std, mean).alias("std_mean"), cosine.alias("mean_cosine"), F.try_divide(F.col("least"), cosine + 1e-8).alias("discrimination"), F.coalesce(F.try_divide(cov, spread), F.lit(0.0)).alias("correlation"),
    )


def silhouette(vectors: DataFrame) -> DataFrame:
    """Mean silhouette of ``label``: distances are summed by (vector, other label) inside each block pair."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        labels = np.sort(pdf["label"].dropna().unique())
        ids = np.sort(pdf["vec_id"].to_numpy())
        total, n, mine = np.zeros((len(ids), len(labels))), np.zeros((len(ids), len(labels)), dtype=np.int64), np.zeros((len(ids), len(labels)), dtype=bool)
        for left, right, _, far, same in _tiles(pdf, BLOCK):
            if same:
                np.fill_diagonal(far, 0.0)
            for own, other, d in [(left, right, far)] if same else [(left, right, far), (right, left, far.T)]:
                has = other["label"].to_numpy()[:, None] == labels[None, :]
                me = own["label"].to_numpy()[:, None] == labels[None, :]
                at = np.searchsorted(ids, own["vec_id"].to_numpy())
                total[at] += d @ has
                n[at] += has.sum(0)[None, :] - (me if same else 0)
                mine[at] = me
        row, col = np.nonzero(n)
        return pd.DataFrame({"a": ids[row], "own": mine[row, col], "other": labels[col].astype("int64"), "total": total[row, col], "n": n[row, col]})

    sums = _block_pairs(vectors, ["v", "label"], BLOCK).groupBy("_i", "_j").applyInPandas(run, "a long, own boolean, other long, total double, n long")
    mean = sums.groupBy("a", "own", "other").agg(F.try_divide(F.sum("total"), F.sum("n").cast("double")).alias("mean"))
    per = mean.groupBy("a").agg(F.max(F.when(F.col("own"), F.col("mean"))).alias("inside"), F.min(F.when(~F.col("own"), F.col("mean"))).alias("outside"))
    s = F.coalesce(F.try_divide(F.col("outside") - F.col("inside"), F.greatest("inside", "outside")), F.lit(0.0))
    return per.agg(F.avg(F.when(F.col("inside").isNull() | F.col("outside").isNull(), 0.0).otherwise(s)).alias("silhouette"), F.avg("inside").alias("mean_own"), F.avg("outside").alias("mean_other"))


def query_cosines(queries: DataFrame, vectors: DataFrame, by: list[str], block: int = BLOCK) -> DataFrame:
    """``query_id, by..., chunk_id, cosine`` of each query vector with every vector of its group: blocks of both sides meet in one matrix product each."""
    sides = max(1, -(-queries.count() // block)), max(1, -(-vectors.count() // block))
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    own = lambda n, name: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(name)
    again = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  new identities: both may be of one origin
    left = again(queries.select("vec_id", "v", *by, own(sides[0], "_i"), spread(sides[1], "_j")))
    right = again(vectors.select("vec_id", "v", *by, spread(sides[0], "_i"), own(sides[1], "_j")))

    def run(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", *by, "chunk_id", "cosine"]
        if not len(q) or not len(c):
            return pd.DataFrame({n: [] for n in names})
        x, y = np.stack(q["v"].to_numpy()).astype(np.float64), np.stack(c["v"].to_numpy()).astype(np.float64)
        size = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
        cosine = np.divide(x @ y.T, size, out=np.zeros(size.shape), where=size > 0)
        made = {"query_id": np.repeat(q["vec_id"].to_numpy(), len(c)), "chunk_id": np.tile(c["vec_id"].to_numpy(), len(q)), "cosine": cosine.ravel()}
        return pd.DataFrame(made | dict(zip(by, key)))[names]

    kinds = "".join(f", {b} {vectors.schema[b].dataType.simpleString()}" for b in by)
    return left.groupBy(*by, "_i", "_j").cogroup(right.groupBy(*by, "_i", "_j")).applyInPandas(run, f"query_id long{kinds}, chunk_id long, cosine double")


def _marked(c: np.ndarray, edge: np.ndarray, more: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what is more (or less) than ``edge`` in ``c``; these are few, so eight entries are looked at at once."""
    flags = np.zeros(-(-c.size // 8) * 8, dtype=bool)
    (np.greater if more else np.less)(c, edge, out=flags[: c.size].reshape(c.shape))
    at = (np.flatnonzero(flags.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[flags[at]], c.shape[1])


def _raised(best: np.ndarray, at: np.ndarray, c: np.ndarray, axis: int, sign: int) -> None:
    """Rows ``at`` of ``best`` (largest first) take what is larger of their rows (or columns, by ``axis``) of ``sign * c``; NaN never is."""
    k, edge = best.shape[1], best[at, -1]
    if np.isinf(edge).any():  # the first that these rows see
        seen = np.nan_to_num(sign * (c if axis == 0 else c.T), nan=-np.inf)
        seen = seen if seen.shape[1] <= k else np.partition(seen, seen.shape[1] - k, axis=1)[:, -k:]
        best[at] = -np.sort(-np.concatenate([best[at], seen], axis=1), axis=1)[:, :k]
        return
    row, col = _marked(c, sign * (edge[:, None] if axis == 0 else edge[None, :]), sign > 0)
    own, value = (col if axis else row), sign * c[row, col]
    order = np.lexsort((-value, own))
    own, value = own[order], value[order]
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    own, value, rank = own[rank < k], value[rank < k], rank[rank < k]
    some, place = np.unique(own, return_inverse=True)
    merged = np.full((len(some), 2 * k), -np.inf)
    merged[:, :k] = best[at[some]]
    merged[place, k + rank] = value
    best[at[some]] = -np.sort(-merged, axis=1)[:, :k]


def extremes(vectors: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``vec_id, _near, _far``: cosines of the ``k`` most and least alike others, best first; each block pair gives its own ``k``, which a fold merges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, products = _products(pdf, block)
        unit = _unit(_matrix(pdf["v"]))
        near, far = np.full((len(pdf), k), -np.inf), np.full((len(pdf), k), -np.inf)
        for left, to, same in products:
            for first in range(0, len(left), ROWS):
                at = left[first : first + ROWS]
                c = unit[at] @ unit[to].T
                if same:
                    c[np.arange(len(at)), first + np.arange(len(at))] = np.nan
                for best, sign in ((near, 1), (far, -1)):
                    _raised(best, at, c, 0, sign)
                    if not same:
                        _raised(best, to, c, 1, sign)
        lists = lambda x: [row[~np.isinf(row)] for row in x]
        return pd.DataFrame({"vec_id": pdf["vec_id"], "_near": lists(near), "_far": lists(-far)})

    found = _block_pairs(vectors, ["v"], block).groupBy("_i", "_j").applyInPandas(run, "vec_id long, _near array<double>, _far array<double>")
    merged = found.groupBy("vec_id").agg(F.flatten(F.collect_list("_near")).alias("_near"), F.flatten(F.collect_list("_far")).alias("_far"))  # k for each block
    return merged.select("vec_id", F.slice(F.sort_array("_near", asc=False), 1, k).alias("_near"), F.slice(F.sort_array("_far"), 1, k).alias("_far"))


def by_smaller(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, n, cosine, most_cosine, euclidean, most_euclidean``: for each vector, over the pairs in which it has the smaller id.

    Sides are sorted, so of most products all rows, or all columns, have the smaller id; sums and extremes are taken of the matrices, a row for each vector of a block pair.
    """
    names = ["n", "cosine", "most_cosine", "euclidean", "most_euclidean"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, products = _products(pdf, block)
        ids, v = pdf["vec_id"].to_numpy(), _matrix(pdf["v"])
        square = (v * v).sum(1)
        size = np.sqrt(square)
        inverse = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
        n, total, most = np.zeros(len(ids), dtype=np.int64), np.zeros((2, len(ids))), np.full((2, len(ids)), -np.inf)

        def add(own, axis, used, cosine, far):
            """Rows (or columns) of a product; ``used`` marks their pairs, None all."""
            n[own] += cosine.shape[axis] if used is None else used.sum(axis)
            for k, x in enumerate((cosine, far)):
                total[k, own] += x.sum(axis) if used is None else np.where(used, x, 0.0).sum(axis)
                most[k, own] = np.maximum(most[k, own], x.max(axis) if used is None else np.where(used, x, -np.inf).max(axis))

        for left, to, same in products:
            y, beside, there = v[to].T, inverse[to][None, :], square[to][None, :]
            for first in range(0, len(left), ROWS):
                at = left[first : first + ROWS]
                far = v[at] @ y
                cosine = far * beside
                cosine *= inverse[at][:, None]
                far *= -2
                far += square[at][:, None]
                far += there
                np.maximum(far, 0.0, out=far)
                np.sqrt(far, out=far)
                if ids[at[-1]] < ids[to[0]]:
                    add(at, 1, None, cosine, far)
                elif ids[to[-1]] < ids[at[0]] and not same:
                    add(to, 0, None, cosine, far)
                else:
                    add(at, 1, ids[at][:, None] < ids[to][None, :], cosine, far)
                    if not same:
                        add(to, 0, ids[at][:, None] > ids[to][None, :], cosine, far)
        made = pd.DataFrame(dict(zip(["a", *names], (ids, n, total[0], most[0], total[1], most[1]))))
        return made[made["n"] > 0]

    part = _block_pairs(vectors, ["v"], block).groupBy("_i", "_j").applyInPandas(run, "a long, n long, cosine double, most_cosine double, euclidean double, most_euclidean double")
    return part.groupBy("a").agg(*[(F.max if c.startswith("most") else F.sum)(c).alias(c) for c in names])


def moments(vectors: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """One row about all pairs: count, sums and squares of distances and cosines, extremes; with ``original``, products with its cosines."""
    rows, columns = vectors, ()
    if original is not None:
        rows, columns = vectors.join(original.select("vec_id", F.col("v").alias("o")), "vec_id"), ("o",)

    kinds = "n long, d double, dd double, least double, most double, c double, cc double, o double, oo double, co double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in kinds.split(", ")]
        made = [own for tile in _tiles(pdf, BLOCK) if (own := one(*tile)) is not None]  # a row a product
        return pd.DataFrame(made)[names] if made else pd.DataFrame({n: [] for n in names})

    def one(left, right, cosine, far, same):
        a, b = left["vec_id"].to_numpy()[:, None], right["vec_id"].to_numpy()[None, :]
        used = a < b if same else a != b
        if not used.any():
            return None
        d, c = far[used], cosine[used]
        own = {"n": len(d), "d": d.sum(), "dd": d @ d, "least": d.min(), "most": d.max(), "c": c.sum(), "cc": c @ c, "o": 0.0, "oo": 0.0, "co": 0.0}
        if columns:
            x, y = (np.stack(side["o"].to_numpy()).astype(np.float64) for side in (left, right))
            dots, size = x @ y.T, np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None, :])
            o = np.divide(dots, size, out=np.zeros_like(dots), where=size > 0)[used]
            own |= {"o": o.sum(), "oo": o @ o, "co": c @ o}
        return own

    part = _block_pairs(rows, ["v", *columns], BLOCK).groupBy("_i", "_j").applyInPandas(run, kinds)
    sums = ("n", "d", "dd", "c", "cc", "o", "oo", "co")
    return part.agg(*[F.sum(x).alias(x) for x in sums], F.min("least").alias("least"), F.max("most").alias("most"))


def dtw(pairs: DataFrame, block: int = 2048) -> DataFrame:
    """``a, b, distance`` of ``pairs(a, b, x, y)``: dynamic time warping, one cell of the recurrence for a batch of pairs at a time."""

    def run(frames):
        for pdf in frames:
            out = np.zeros(len(pdf))
            sizes = list(zip(pdf["x"].map(len), pdf["y"].map(len)))
            for n, m in set(sizes):
                at = np.array([k for k, s in enumerate(sizes) if s == (n, m)])
                for part in np.array_split(at, -(-len(at) // block)):
                    if not n or not m:
                        out[part] = 0.0 if n == m else np.inf
                        continue
                    x, y = np.stack(pdf["x"].iloc[part].to_numpy()), np.stack(pdf["y"].iloc[part].to_numpy())
                    before = np.full((m + 1, len(part)), np.inf)
                    before[0] = 0.0
                    for i in range(n):
                        row = np.full((m + 1, len(part)), np.inf)
                        for j in range(m):
                            row[j + 1] = np.abs(x[:, i] - y[:, j]) + np.minimum(np.minimum(before[j], before[j + 1]), row[j])
                        before = row
                    out[part] = before[m]
            yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "distance": out})

    return pairs.select("a", "b", "x", "y").mapInPandas(run, "a long, b long, distance double")
