"""Training objectives as aggregates over a table of pairs: what a model's vectors would lose, without training one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine


def pair_cosines(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` with ``_pos`` and ``_neg``, the anchor's cosines to its positive and its negative; a zero vector is at 0 from all. Pairs that lack a vector go."""
    out = pairs
    for c in ("anchor", "positive", "negative"):
        out = out.join(vectors.select(F.col("vec_id").alias(c), F.col("v").alias(f"_v_{c}")), c)
    near = lambda c: F.coalesce(cosine(F.col("_v_anchor"), F.col(f"_v_{c}")), F.lit(0.0))
    return out.select(*pairs.columns, near("positive").alias("_pos"), near("negative").alias("_neg"))


def triplet_loss(cosines: DataFrame, by: list[str], margin: float = 0.2) -> DataFrame:
    """Mean of max(0, (1 - pos) - (1 - neg) + margin), the share of pairs that lose nothing, and the mean cosine to the positive."""
    loss = F.greatest(F.lit(0.0), F.col("_neg") - F.col("_pos") + margin)
    return cosines.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg((loss == 0).cast("double")).alias("satisfied"), F.avg("_pos").alias("mean_positive"))


def infonce_loss(cosines: DataFrame, by: list[str], temperature: float = 0.05) -> DataFrame:
    """Mean cross entropy of the positive against its own negative, two logits a pair, as ln(1 + e^gap) without overflow."""
    gap = (F.col("_neg") - F.col("_pos")) / temperature
    loss = F.greatest(F.lit(0.0), gap) + F.log1p(F.exp(-F.abs(gap)))
    return cosines.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"), F.avg((gap < 0).cast("double")).alias("accuracy"))


def uniformity_penalty(pairs: DataFrame, vectors: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``n, mean_similarity, penalty`` over all vectors of all pairs, with repetitions: (mean cosine of two different ones - threshold)^2 where it is above.

    The mean over all pairs of vectors follows from their sum, (|sum|^2 - sum of |v|^2) / n (n - 1), so no pair of vectors is made.
    """
    used = pairs.select(F.explode(F.array("anchor", "positive", "negative")).alias("vec_id")).groupBy("vec_id").agg(F.count(F.lit(1)).alias("_n"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = used.join(vectors.select("vec_id", "v", norm.alias("_norm")), "vec_id").select("_n", F.when(F.col("_norm") > 0, 1).otherwise(0).alias("_one"), F.transform("v", lambda x: F.coalesce(F.try_divide(x, F.col("_norm")), F.lit(0.0))).alias("u"))
    counts = unit.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_one")).alias("_ones"))
    sums = unit.select("_n", F.posexplode("u").alias("_dim", "_x")).groupBy("_dim").agg(F.sum(F.col("_n") * F.col("_x")).alias("_s"))
    square = sums.agg(F.sum(F.col("_s") * F.col("_s")).alias("_square"))
    both = counts.crossJoin(square)  # one row each
    mean = F.try_divide(F.col("_square") - F.col("_ones"), F.col("n").cast("double") * (F.col("n") - 1))
    return both.select("n", mean.alias("mean_similarity"), F.when(mean > threshold, (mean - threshold) * (mean - threshold)).otherwise(F.lit(0.0)).alias("penalty"))
