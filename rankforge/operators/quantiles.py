"""Exact quantiles of groups of any size, by histograms that close in on the values asked for.

Each round counts the rows of every open interval in equal bins (an aggregate, partial before the exchange) and goes on with the bin that
holds the rank in question, between the least and the largest value really found there; it ends when both are the same. A task never holds
more of a group than its bins. Bins are equal by value and, every other round, by signed logarithm, so that values of any spread are found in a
bounded number of rounds (some 16; two to five as a rule; ties end at once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import stored

BINS = 256
#: Intervals up to this number are sent to every task.
SMALL_ROWS = 100_000


def exact_quantiles(df: DataFrame, columns: list[str], by: list[str], shares: dict[str, float]) -> DataFrame:
    """``by..., <column>_<name>...``: linearly interpolated quantiles; nulls don't count, a group without values has null.

    ``df`` is read once a round, so it should be a stored table.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])).alias("_x")
    rows = df.select(*[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], each).select(*[f"_b{i}" for i in range(len(by))], "_x._i", "_x._v").where("_v IS NOT NULL")
    keys = [*[f"_b{i}" for i in range(len(by))], "_i"]
    spans = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "spans")
    place = {name: F.lit(q) * (F.col("_n") - 1) for name, q in shares.items()}
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place.values() for f in (F.floor, F.ceil)]))
    state = spans.select(*keys, F.explode(ranks).alias("_rank"), "_low", "_high").withColumn("_left", F.col("_rank"))
    found, turn = None, 0
    while True:
        state = stored(state, "intervals")
        done = state.where("_low = _high")
        found = done if found is None else found.unionByName(done)
        state = state.where("_low < _high")
        n = state.count()
        if not n:
            break
        state, turn = _narrowed(rows, state, keys, n, turn % 2 == 1), turn + 1
    values = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_low"))).alias("_at"))  # two entries a share at most
    made = spans.join(values, [spans[k].eqNullSafe(values[k]) for k in keys]).select(*[spans[k] for k in keys], "_n", "_at")
    at = lambda p: F.element_at("_at", p.cast("long"))
    quantile = {name: at(F.floor(p)) + (at(F.ceil(p)) - at(F.floor(p))) * (p - F.floor(p)) for name, p in place.items()}
    wide = [F.max(F.when(F.col("_i") == i, q)).alias(f"{c}_{name}") for i, c in enumerate(columns) for name, q in quantile.items()]
    groups = df.select(*by).distinct() if by else None
    made = made.groupBy(*keys[:-1]).agg(*wide)
    if groups is None:
        return made
    joined = groups.join(made, [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)], "left")
    return joined.drop(*keys[:-1])


def _signed_log(v: Column) -> Column:
    """Rising with v; from 0 to 1455 on each side of zero."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.ln(F.when(v != 0, F.abs(v))) + 745))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str], n: int, by_log: bool) -> DataFrame:
    """Each interval cut down to the bin of its rank."""
    scale = _signed_log if by_log else lambda v: v / 2  # noqa: E731  half: a difference can't overflow
    named = state.select(*[F.col(k).alias(f"_s{k}") for k in keys], "_rank", "_left", "_low", "_high")
    right = F.broadcast(named) if n <= SMALL_ROWS else named
    inside = rows.join(right, [F.col(k).eqNullSafe(F.col(f"_s{k}")) for k in keys]).where(F.col("_v").between(F.col("_low"), F.col("_high")))
    low = scale(F.col("_low"))
    share = F.try_divide(scale(F.col("_v")) - low, scale(F.col("_high")) - low)
    part = F.coalesce(F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(share * BINS))), F.when(F.col("_v") < F.col("_high"), 0).otherwise(BINS - 1)).cast("int")
    bins = inside.groupBy(*keys, "_rank", "_left", part.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys, "_rank").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.withColumn("_before", before).where((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("_c")))
    return bins.select(*keys, "_rank", "_low", "_high", (F.col("_left") - F.col("_before")).alias("_left"))
