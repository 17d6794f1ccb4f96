"""Weights learnt from how earlier, similar queries went; tables instead of a history that is carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The length that a pattern's group stands for, its mean word length, the least similarity, entries kept of a pattern.
GROUP_LENGTH, MEAN_LENGTH, ALIKE, KEPT = {"short": 3, "medium": 6, "long": 10}, 5.0, 0.7, 10
FLAGS = ("has_medical", "has_question", "has_technical")


def closeness(a: Column, b: Column) -> Column:
    return 1 - F.abs(a - b) / F.greatest(a, b, F.lit(1))


def alike_flags(same: Column) -> Column:
    """0.4 of the share of three flags, as 0.4, 0.8 or 1.2 over 3: in its SQL 0.4 times a count is a decimal, and some similarities lie on the threshold."""
    return 4 * same / 10.0 / 3.0


def pattern_similarity(features: DataFrame, patterns: DataFrame) -> DataFrame:
    """``query_id, pattern, similarity``: .4 by length, .4 by the share of equal flags, .2 by mean word length.

    ``patterns(pattern, group, flags...)`` is a small table (three groups by eight combinations of flags).
    """
    length = F.create_map(*[F.lit(x) for kv in GROUP_LENGTH.items() for x in kv])[F.col("group")]
    known = F.broadcast(patterns.select("pattern", length.alias("_length"), *[F.col(c).alias(f"_{c}") for c in FLAGS]))
    same = sum(((F.col(c) == F.col(f"_{c}")).cast("int") for c in FLAGS), F.lit(0))
    score = 0.4 * closeness(F.col("n_words"), F.col("_length")) + alike_flags(same) + 0.2 * closeness(F.col("mean_length"), F.lit(MEAN_LENGTH))
    return features.drop("pattern").crossJoin(known).select("query_id", "pattern", score.alias("similarity"))


def history_weights(features: DataFrame, patterns: DataFrame, success: DataFrame) -> DataFrame:
    """``query_id, n_similar, mrf_weight, emb_weight`` from the ten latest earlier queries of every similar pattern.

    ``features(query_id, pattern, ...)``, ``success(query_id, mrf, emb)`` as 0 and 1. Queries come in the order of their
    ids. The latest ten before a query are a difference of running sums: the pattern's entries are numbered, and each query
    looks up two numbers. Weights are the shares of success, held within .2 and .8; even without any.
    """
    order = Window.partitionBy("pattern").orderBy("query_id")
    entries = features.select("query_id", "pattern").join(success, "query_id", "left").select("query_id", "pattern", F.coalesce("mrf", F.lit(0)).alias("mrf"), F.coalesce("emb", F.lit(0)).alias("emb"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = entries.select("pattern", F.row_number().over(order).alias("r"), F.sum("mrf").over(running).alias("mrf"), F.sum("emb").over(running).alias("emb"))
    alike = pattern_similarity(features, patterns).where(F.col("similarity") > ALIKE)
    marked = alike.join(entries.select("query_id", "pattern", F.lit(1).alias("own")), ["query_id", "pattern"], "full").select("query_id", "pattern", F.coalesce("own", F.lit(0)).alias("own"), F.col("similarity").isNotNull().alias("asks"))
    before = marked.withColumn("c", F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("asks AND c > 0")
    at = lambda name, r: sums.select("pattern", (F.col("r") + r).alias("c"), F.col("mrf").alias(f"{name}_mrf"), F.col("emb").alias(f"{name}_emb"))
    last = before.join(at("to", 0), ["pattern", "c"]).join(at("from", KEPT), ["pattern", "c"], "left")
    less = lambda c: F.sum(F.col(f"to_{c}") - F.coalesce(f"from_{c}", F.lit(0)))
    found = last.groupBy("query_id").agg(F.sum(F.least("c", F.lit(KEPT))).alias("n_similar"), less("mrf").alias("mrf"), less("emb").alias("emb"))
    out = features.select("query_id").join(found, "query_id", "left")
    held = lambda c: F.least(F.lit(0.8), F.greatest(F.lit(0.2), F.coalesce(F.try_divide(F.col(c), F.col("mrf") + F.col("emb")), F.lit(0.5))))
    total = held("mrf") + held("emb")
    return out.select("query_id", F.coalesce("n_similar", F.lit(0)).alias("n_similar"), (held("mrf") / total).alias("mrf_weight"), (held("emb") / total).alias("emb_weight"))
