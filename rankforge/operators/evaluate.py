"""Retrieval evaluation over ranked tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10, 20, 30)


def metrics_at_k(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS, first: DataFrame | None = None) -> DataFrame:
    """``query_id, k, recall, precision, ndcg, f1, mrr`` for ``ranked(query_id, chunk_id, rank)``; precision divides by k.

    Where ``ranked`` was cut, ``first(query_id, first)`` gives the first relevant rank of all.
    """
    total = relevant.select("query_id", "chunk_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    hits = ranked.join(relevant.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi").select("query_id", "rank")
    asked = ranked.select("query_id").distinct().join(total, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    grid = asked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first")) if first is None else first
    inside = F.col("rank") <= F.col("k")
    per = grid.join(hits, "query_id", "left").groupBy("query_id", "k", "n_rel").agg(
        F.sum(F.when(inside, 1).otherwise(0)).alias("hit"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    ideal = F.when(F.col("n_rel") > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_rel", "k")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)))
    recall, precision = F.try_divide("hit", "n_rel"), F.col("hit") / F.col("k")
    out = per.join(first, "query_id", "left").select(
        "query_id", "k", F.coalesce(recall, F.lit(0.0)).alias("recall"), precision.alias("precision"),
        F.coalesce(F.try_divide(F.col("dcg"), ideal), F.lit(0.0)).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )
    both = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when(both > 0, F.try_divide(2 * F.col("recall") * F.col("precision"), both)).otherwise(0.0))


def improvement(new: Column, base: Column) -> Column:
    """Change in percent; 0 from 0 to 0, infinite from 0 to more."""
    return F.when(base > 0, F.try_divide(new - base, base) * 100).when(new > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def metrics_aggregate(metrics: DataFrame, names: tuple[str, ...] = ("recall", "precision", "ndcg", "f1", "mrr")) -> DataFrame:
    """``k, metric, mean, std, min, max`` over queries."""
    long = metrics.unpivot(["query_id", "k"], list(names), "metric", "value")
    return long.groupBy("k", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def improvements_aggregate(changes: DataFrame) -> DataFrame:
    """``k, n, n_finite, mean, std, min, max`` of the finite changes in percent."""
    finite = F.when(F.abs("change") < float("inf"), F.col("change"))
    made = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return changes.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count(finite).alias("n_finite"), *[f(finite).alias(name) for name, f in made.items()])


def topn_accuracy(positions: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, top1, top3, top5, mrr`` over ``positions(by..., position)``; a missing position adds 0."""
    share = lambda k: F.avg(F.when(F.col("position") <= k, 1.0).otherwise(0.0)).alias(f"top{k}")
    mrr = F.avg(F.coalesce(1 / F.col("position"), F.lit(0.0))).alias("mrr")
    aggs = [F.count(F.lit(1)).alias("n"), share(1), share(3), share(5), mrr]
    return positions.groupBy(*by).agg(*aggs) if by else positions.agg(*aggs)


def model_metrics(found: DataFrame, by: list[str]) -> DataFrame:
    """``acc1, acc5, mrr, map, ndcg5, mean_similarity, not_found`` over ``found(by, position (<= 5 or null), score)``."""
    p = F.col("position")
    return found.groupBy(*by).agg(
        F.avg(F.when(p == 1, 1.0).otherwise(0.0)).alias("acc1"), F.avg(F.when(p <= 5, 1.0).otherwise(0.0)).alias("acc5"),
        F.avg(F.coalesce(1 / p, F.lit(0.0))).alias("mrr"), F.avg(F.coalesce(1 / p, F.lit(0.0))).alias("map"),
        F.avg(F.coalesce(1 / F.log2(p + 1), F.lit(0.0))).alias("ndcg5"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_similarity"),
        F.sum(p.isNull().cast("long")).alias("not_found"),
    )


def score_distributions(scores: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    long = scores.unpivot(by, columns, "signal", "value")
    return long.groupBy(*by, "signal").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.percentile("value", 0.5).alias("median"))


def correlation(a: str, b: str) -> Column:
    """Pearson's r from population moments; 0 where a side is constant."""
    both = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(F.round(both, 12) == 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.covar_pop(a, b), both), F.lit(0.0)))


def component_correlations(scores: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return scores.groupBy(*by).agg(*[correlation(a, b).alias(f"{a}__{b}") for a, b in pairs])
