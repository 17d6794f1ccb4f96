"""Whitening of embeddings by a two-pass covariance.

Entries become whole numbers, so the first pass gives sums and a mean that are exact. The second sums outer products of the centred
vectors: a matrix product for each batch, one small matrix for each task, merged by a tree. LAPACK's symmetric solver runs once, on a
matrix of dimensions only; its projection goes to every task. A last pass measures the covariance of what comes out.

Defined results: vectors that are null or empty, hold null or non-finite entries, or have another length than most valid vectors (the longer of
equals) give no rows; a null id is passed through; repeated rows each count and each give rows; without variance (one vector, equal
vectors, directions that are sums of others) ``whitened`` is null, and ``explained`` too where there is none at all; a deviation beyond 64 bits is null; an
entry beyond 64 bits is the largest or smallest whole number of 64 bits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the quantisation: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64.0, 1_000_000
_LARGEST = 2**63 - 1
_STEP = 2048


@dataclass
class Whitening:
    """``components`` are columns, by falling eigenvalue; each has its largest entry positive."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def solid(self) -> np.ndarray:
        """Components with a variance beyond rounding."""
        e = self.eigenvalues
        return e > (e[0] if len(e) else 0.0) * len(self.sums) * np.finfo(np.float64).eps


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """``_id, _v`` (doubles) of the vectors that count, and their dimension (0: there is none)."""
    rows = table.select(F.col(id_col).alias("_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where((F.size("_v") > 0) & finite)
    common = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = common.d if common else 0
    return rows.where(F.size("_v") == d), d


def _whole(column: pa.Array, d: int) -> np.ndarray:
    """A batch's entries as whole numbers, a row for each vector."""
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
    if np.abs(scaled).max(initial=0.0) < 2.0**62:
        return scaled.astype(np.int64) + SHIFT
    exact = [max(-_LARGEST - 1, min(_LARGEST, int(x) + SHIFT)) for x in scaled.ravel().tolist()]
    return np.array(exact, dtype=np.int64).reshape(-1, d)


def _batches(frames, d: int):
    for batch in frames:
        for at in range(0, batch.num_rows, _STEP):
            part = batch.slice(at, _STEP)
            yield part.column(0), _whole(part.column(1), d)


def _distances(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where it fits, else as Python integers."""
    middle = [s // n for s in sums]
    rest = [n * m - s for m, s in zip(middle, sums)]
    span = max(int(x.max()) - min(middle), max(middle) - int(x.min())) if x.size else 0
    if span * n < 2**62:
        return (x - np.array(middle, dtype=np.int64)) * n + np.array(rest, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _deviations(far: np.ndarray) -> list[int | None]:
    if far.dtype != object and (far.astype(np.float64) ** 2).sum(1).max(initial=0.0) < 2.0**62:
        return (far * far).sum(1).tolist()
    exact = [sum(v * v for v in row) for row in far.tolist()]
    return [x if x <= _LARGEST else None for x in exact]


def _partials(rows: DataFrame, d: int, start, add):
    """One value for each task (``add`` folds a batch of whole vectors into it), as rows of an RDD for the tree to merge."""

    def run(frames):
        made = start()
        for _, x in _batches(frames, d):
            made = add(made, x)
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["_part"])

    return rows.mapInArrow(run, "_part binary").rdd.map(lambda r: bytes(r[0]))


def _exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Count and sums, added as two halves of 32 bits, so that no batch overflows."""
    fields = 1 + 2 * d

    def add(state: bytes, x: np.ndarray) -> bytes:
        seen = np.frombuffer(state, dtype="<i8")
        return (seen + np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])).astype("<i8").tobytes()

    def merge(a: list[int], b: list[int]) -> list[int]:
        return [x + y for x, y in zip(a, b)]

    parts = _partials(rows, d, lambda: np.zeros(fields, dtype="<i8").tobytes(), add).map(lambda p: np.frombuffer(p, dtype="<i8").tolist())
    total = parts.treeAggregate([0] * fields, merge, merge)
    return total[0], [(total[1 + i] << 32) + total[1 + d + i] for i in range(d)]


def _matrix_sum(rows: DataFrame, d: int, k: int, outer) -> np.ndarray:
    """The sum over all batches of ``outer(x)``, a k x k matrix."""
    add = lambda state, x: (np.frombuffer(state).reshape(k, k) + outer(x)).tobytes()
    parts = _partials(rows, d, lambda: np.zeros((k, k)).tobytes(), add).map(lambda p: np.frombuffer(p).reshape(k, k))
    return parts.treeAggregate(np.zeros((k, k)), lambda a, b: a + b, lambda a, b: a + b)


def fit_whitening(rows: DataFrame, d: int) -> Whitening:
    n, sums = _exact_sums(rows, d)

    def outer(x: np.ndarray) -> np.ndarray:
        centred = _distances(x, n, sums).astype(np.float64) / n
        return centred.T @ centred

    covariance = _matrix_sum(rows, d, d, outer) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    largest = vectors[np.abs(vectors).argmax(0), np.arange(d)]
    return Whitening(n, sums, values, vectors * np.where(largest < 0, -1.0, 1.0), float(np.trace(covariance)))


def _projection(fit: Whitening, k: int):
    """``x -> (distances, whitened)`` for the first k components, those without variance left out."""
    solid = np.flatnonzero(fit.solid[:k])
    scaled = fit.components[:, solid] / np.sqrt(fit.eigenvalues[solid])

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = _distances(x, fit.n, fit.sums)
        return far, (far.astype(np.float64) / fit.n) @ scaled

    return project, solid


def whiten(table: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each valid vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``."""
    rows, d = valid_vectors(table, id_col, vec_col)
    kind = table.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if d == 0:
        return table.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    fit, k = fit_whitening(rows, d), min(components, d)
    project, solid = _projection(fit, k)
    m = len(solid)

    def outer(x: np.ndarray) -> np.ndarray:
        w = project(x)[1]
        one = np.column_stack([w, np.ones(len(w))])
        return one.T @ one

    total = _matrix_sum(rows, d, m + 1, outer) / fit.n
    error = float(np.abs(total[:m, :m] - np.outer(total[:m, m], total[:m, m]) - np.eye(m)).max()) if m else None
    explained = (fit.eigenvalues[:k] / fit.trace).tolist() if fit.trace > 0 else [None] * k
    count = fit.n

    def run(frames):
        for ids, x in _batches(frames, d):
            far, w = project(x)
            full = np.full((len(x), k), np.nan)
            full[:, solid] = w
            at = np.repeat(np.arange(len(x)), k)
            size = len(at)
            whitened = pa.array(full.ravel(), pa.float64(), mask=np.isnan(full.ravel()))
            columns = [
                ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(size, count)), pa.array(_deviations(far), pa.int64()).take(pa.array(at)),
                whitened, pa.array(explained * len(x), pa.float64()), pa.array([error] * size, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
