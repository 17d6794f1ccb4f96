"""Score normalisation and fusion.

Statistics of a group are aggregates (partial before the exchange) that return to its rows by a join on the group,
so no group of any size passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keep import stored
from .quantiles import exact_quantiles

#: Groups up to this number (a few numbers each) are sent to every task.
SMALL_GROUPS = 100_000


def _with_stats(df: DataFrame, columns: list[str], by: list[str], made: dict, shares: dict[str, float] | None = None) -> tuple[DataFrame, list[str]]:
    """``df`` with ``made``'s statistics (name -> aggregate of a column) and the quantiles ``shares`` of each column, as ``_<column>_<name>``."""
    names = {f"_{c}_{n}": f(c) for c in columns for n, f in made.items()}
    stats = df.groupBy(*by).agg(*[x.alias(n) for n, x in names.items()])
    if shares:
        quantiles = exact_quantiles(df, columns, by, shares)
        quantiles = quantiles.select(*by, *[F.col(f"{c}_{n}").alias(f"_{c}_{n}") for c in columns for n in shares])
        stats, names = stats.join(quantiles, by), {**names, **{f"_{c}_{n}": None for c in columns for n in shares}}
    stats = stored(stats, "stats")
    return df.join(F.broadcast(stats) if stats.count() <= SMALL_GROUPS else stats, by), list(names)


_RANGE = {"min": F.min, "max": F.max}
_QUARTILES = {"p25": 0.25, "p75": 0.75}


def _span(c: str, x: Column, constant: float, low: float = 0.0, high: float = 1.0, edge=lambda v: v) -> Column:
    least, most = edge(F.col(f"_{c}_min")), edge(F.col(f"_{c}_max"))
    return F.when(most == least, F.lit(constant)).otherwise(low + F.try_divide((x - least) * (high - low), most - least))


def zscore(df: DataFrame, columns: list[str], by: list[str], clip: float | None = 3.0) -> DataFrame:
    """Population z-scores; 0 for constants; clipped after scaling."""
    rows, extra = _with_stats(df, columns, by, {"mean": F.avg, "sd": F.stddev_pop})

    def z(c):
        sd = F.col(f"_{c}_sd")
        made = F.when(F.round(sd, 12) == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(c) - F.col(f"_{c}_mean"), sd))
        return made if clip is None else F.greatest(F.lit(-float(clip)), F.least(F.lit(float(clip)), made))

    return rows.withColumns({c: z(c) for c in columns}).drop(*extra)


def minmax(df: DataFrame, columns: list[str], by: list[str], constant: float = 0.5) -> DataFrame:
    rows, extra = _with_stats(df, columns, by, _RANGE)
    return rows.withColumns({c: _span(c, F.col(c), constant) for c in columns}).drop(*extra)


def _robust(c: str, x: Column, clip: float = 2.0) -> Column:
    p25, p75 = F.col(f"_{c}_p25"), F.col(f"_{c}_p75")
    scaled = F.greatest(F.lit(-clip), F.least(F.lit(clip), F.try_divide(x - p25, p75 - p25)))
    return F.when(p75 == p25, _span(c, x, 0.0)).otherwise(scaled)


def robust(df: DataFrame, columns: list[str], by: list[str], clip: float = 2.0) -> DataFrame:
    """(x - p25) / IQR, clipped; min-max where the IQR is 0; 0 for constants."""
    rows, extra = _with_stats(df, columns, by, _RANGE, _QUARTILES)
    return rows.withColumns({c: _robust(c, F.col(c), clip) for c in columns}).drop(*extra)


def scale_to_range(df: DataFrame, columns: list[str], by: list[str], low: float = 0.3, high: float = 0.7) -> DataFrame:
    rows, extra = _with_stats(df, columns, by, _RANGE)
    return rows.withColumns({c: _span(c, F.col(c), (low + high) / 2, low, high) for c in columns}).drop(*extra)


def normalize_all(df: DataFrame, columns: list[str], by: list[str], method: str = "zscore", clip: float | None = 3.0) -> DataFrame:
    made = {"none": lambda: df, "zscore": lambda: zscore(df, columns, by, clip), "minmax": lambda: minmax(df, columns, by), "robust": lambda: robust(df, columns, by)}
    if method not in made:
        raise ValueError(f"unknown normalisation: {method}")
    return made[method]()


def normalize_intelligent(df: DataFrame, columns: list[str], by: list[str], low: float = 0.3, high: float = 0.7) -> DataFrame:
    """Robust, then scaled to a range. The first step keeps the order, so its extremes are those of the scores."""
    rows, extra = _with_stats(df, columns, by, _RANGE, _QUARTILES)
    both = lambda c: _span(c, _robust(c, F.col(c)), (low + high) / 2, low, high, edge=lambda v: _robust(c, v))
    return rows.withColumns({c: both(c) for c in columns}).drop(*extra)


def row_zscore(df: DataFrame, columns: list[str], clip: float = 3.0) -> DataFrame:
    """Each signal of a row against the row's other signals, in place."""
    values = F.col("_values")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / len(columns)
    sd = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / len(columns))
    z = lambda x: F.when(F.round(sd, 12) == 0, F.lit(0.0)).otherwise(F.try_divide(x - mean, sd))
    made = {c: F.greatest(F.lit(-clip), F.least(F.lit(clip), z(values[i]))) for i, c in enumerate(columns)}
    return df.withColumn("_values", F.array(*columns)).withColumns(made).drop("_values")


def combine(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for column, weight in weights.items():
        out = out + weight * F.col(column)
    return out


def adaptive_weights(n: Column) -> tuple[Column, Column]:
    """MRF and embedding weights by the number of query words."""
    mrf = F.when(n <= 3, 0.4).when(n <= 6, 0.5).when(n <= 10, 0.7).otherwise(0.8)
    emb = F.when(n <= 3, 0.6).when(n <= 6, 0.5).when(n <= 10, 0.3).otherwise(0.2)
    return mrf, emb


def weighted_average_fusion(scores: DataFrame, weights: DataFrame, by: list[str], doc: str = "doc") -> DataFrame:
    """``scores(by, model, doc, score)`` (documents' best) -> 100 * sum of weight * score; a model without the document adds 0."""
    return scores.join(F.broadcast(weights), "model").groupBy(*by, doc).agg((100 * F.sum(F.col("weight") * F.col("score"))).alias("score"))


def rrf_fusion(ranked: DataFrame, weights: DataFrame, by: list[str], doc: str = "doc", k: int = 60) -> DataFrame:
    """``ranked(by, model, doc, rank)`` of chunks -> 100 * sum of weight / (k + rank); a document's chunks add up."""
    return ranked.join(F.broadcast(weights), "model").groupBy(*by, doc).agg((100 * F.sum(F.col("weight") / (k + F.col("rank")))).alias("score"))
