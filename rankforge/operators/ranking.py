"""Ranking with an explicit total order: rounded score descending, then the key ascending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keep import stored

#: Groups up to this number (a few numbers each) are sent to every task.
SMALL_GROUPS = 100_000


def rounded(score: str, digits: int) -> Column:
    """``score`` in units of its last digit, for an order: halves of the product in doubles go away from zero, as in the SQL's ``round``.

    ``F.round(score, digits)`` goes by the decimal digits instead, and takes a score whose product lies below the half for one above it.
    """
    return F.round(F.col(score) * 10.0**digits)


def _order(score: str, tie: list[str], digits: int, descending: bool = True) -> list[Column]:
    units = rounded(score, digits)
    return [units.desc() if descending else units.asc(), *[F.col(t) for t in tie]]


def rank_by(df: DataFrame, by: list[str], score: str = "score", tie: list[str] | None = None, digits: int = 6, descending: bool = True, name: str = "rank") -> DataFrame:
    """1..n inside each ``by``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*_order(score, tie or ["chunk_id"], digits, descending))))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """1..n inside each ``by`` in ``order`` (total, but for rows that may change places), without a group in one task.

    Rows are dealt to ranges of (by, order), so a large group is spread over many of them; each range numbers its own rows, and the counts
    of the ranges before, a row for each range and group, move the numbers on.
    """
    first = [F.col(b).asc_nulls_first() for b in by]
    dealt = df.repartitionByRange(*first, *order, F.monotonically_increasing_id()).sortWithinPartitions(*first, *order)
    dealt = stored(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    counts = dealt.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = stored(counts.select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)], (before - F.col("_first") + 1).alias("_move")), "moves")
    same = [F.col("_range") == F.col("_r"), *[F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]]
    joined = dealt.join(F.broadcast(moved) if moved.count() <= SMALL_GROUPS else moved, same)
    return joined.select(*[F.col(c) for c in df.columns if c != name], (F.col("_at") + F.col("_move")).alias(name))


def rank_all(df: DataFrame, by: list[str], score: str = "score", tie: list[str] | None = None, digits: int = 6, descending: bool = True, name: str = "rank") -> DataFrame:
    """``rank_by`` for groups of any size, where every row is asked for."""
    return numbered(df, by, _order(score, tie or ["chunk_id"], digits, descending), name)


def top_k(df: DataFrame, k: int, by: list[str], score: str = "score", tie: list[str] | None = None, digits: int = 6, descending: bool = True) -> DataFrame:
    """The first ``k`` of each ``by``; Spark keeps only k rows a task and group before the exchange."""
    return rank_by(df, by, score, tie, digits, descending).where(F.col("rank") <= k)


def first_position(scores: DataFrame, relevant: DataFrame, by: list[str], score: str = "score", key: str = "chunk_id", digits: int = 6) -> DataFrame:
    """``by, position``: the rank, among all scores of its group, of the first relevant key; ties by key.

    It is one more than the number of scores before it, which an aggregate counts; nothing is sorted.
    """
    order = F.struct(rounded(score, digits).alias("s"), (-F.col(key)).alias("t"))
    named = relevant.select(*[c for c in by if c in relevant.columns], key).distinct()
    best = stored(scores.join(named, [c for c in by if c in relevant.columns] + [key], "left_semi").groupBy(*by).agg(F.max(order).alias("best")), "best")
    ahead = scores.join(F.broadcast(best) if best.count() <= SMALL_GROUPS else best, by).where(order >= F.col("best"))
    return ahead.groupBy(*by).agg(F.count(F.lit(1)).alias("position"))


def doc_max_pool(df: DataFrame, by: list[str], doc: str = "doc", score: str = "score", tie: str = "chunk_id", digits: int = 6) -> DataFrame:
    """The best chunk of each document: an aggregate, partial before the exchange."""
    best = F.max(F.struct(rounded(score, digits).alias("s"), (-F.col(tie)).alias("t"), F.col(score).alias("score"))).alias("_best")
    return df.groupBy(*by, doc).agg(best).select(*by, doc, F.col("_best.score").alias("score"), (-F.col("_best.t")).alias(tie))


def last_n_per_key(df: DataFrame, n: int, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order]))).where(F.col("rank") <= n)


def best_config(df: DataFrame, metric: str, tie: list[str], digits: int = 6) -> DataFrame:
    return df.orderBy(rounded(metric, digits).desc(), *tie).limit(1)


def cumulative_share(df: DataFrame, value: str, order: list[Column], by: list[str]) -> DataFrame:
    """Running sum of ``value`` over the total of its group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(value).over(w) / F.sum(value).over(Window.partitionBy(*by)))
