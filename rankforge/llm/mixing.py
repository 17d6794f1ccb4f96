"""Mixing sources to target weights by entropy balancing; DataFrame operations only.

Document rates w stay as close to 1 as the constraints allow: they minimise sum(w ln w - w) under
"each source's rated words make its target" and w <= cap. The convex dual has one multiplier per source,
and its solution tilts exponentially: w = min(cap, exp(multiplier * size / mean size)). All documents of
one size in a source have one rate, so Newton's iterations run over the histogram (source, size, count):
one aggregate each, whatever the number of documents, with a bracket that halves where a step leaves it.
Sums are exact decimals, so the order of rows doesn't matter and reruns agree.

Rates become copies by error diffusion: documents are dealt by a hash of their id and text to buckets of
some hundred within their source, and each bucket, from long to short documents, takes a copy more whenever
what it owes is at least half of the document. A bucket's rest is about the size of its shortest
documents, and the largest source has as many more buckets as it has documents. Rows that repeat both id and
text meet in one bucket; one that grows beyond ``CROWDED`` is split by the number of the row.

Defined results: a null text has size 0, and a document of size 0 is taken 0 words; null is a source of
its own, last in order; a null id is passed through and rows that repeat an id are mixed one by one (equal
rows may differ in copies); a source without words has target 0; an empty table gives an empty result;
other columns are ignored. The number of sources is assumed to fit one task's window (one row each).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import WORD_CLASS, checkpoint, text_or_empty

BUCKET = 256
#: Rows from which a bucket is split.
CROWDED = 4 * BUCKET
#: Sources up to this number are sent to every task (about 100 bytes each); more are joined by exchange.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")


def _same(left: DataFrame, right: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Joins on ``_source``, null matching null."""
    right = right.withColumnRenamed("_source", "_right")
    return left.join(F.broadcast(right) if small else right, F.col("_source").eqNullSafe(F.col("_right")), how).drop("_right")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``_source, _n, _words, _target``: by weight, capped at ``cap`` times the source, the excess reshared.

    Sources fill up in the order of cap per weight, so the resharing ends at the first k for which what is
    left for the other sources, by weight, stays below the next one's cap; no loop is needed.
    """
    per = sizes.groupBy("_source").agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") * F.col("_size")).alias("_words"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_weight", F.get(cycle, (rank % len(weights)).cast("int")))
    per = per.withColumn("_most", F.lit(float(cap)) * F.col("_words")).withColumn("_level", F.col("_most") / F.col("_weight"))
    order = Window.orderBy("_level", F.col("_source").asc_nulls_last())
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.least(F.lit(float(share)) * F.sum("_words").over(all_rows), F.sum("_most").over(all_rows))
    left = budget - F.coalesce(F.sum("_most").over(before), F.lit(0.0))
    rest = F.sum("_weight").over(all_rows) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    per = per.withColumn("_fair", left / rest)  # per unit of weight, if all before are full
    stop = F.min(F.when(F.col("_fair") <= F.col("_level"), F.col("_level"))).over(all_rows)
    fair = F.min(F.when(F.col("_fair") <= F.col("_level"), F.struct("_level", "_source", "_fair"))).over(all_rows)["_fair"]
    full = fair.isNull() | (F.col("_level") < stop)
    target = F.when(full, F.col("_most")).otherwise(F.least(F.col("_most"), F.col("_weight") * fair))
    return per.select("_source", "_n", "_words", "_weight", target.alias("_target"))


def _rate(multiplier: Column, cap: float) -> Column:
    """min(cap, exp(multiplier * size / mean)), rounded, so that the last bits of exp don't matter."""
    tilt = F.exp(F.least(multiplier * F.col("_size") / F.col("_mean"), F.lit(50.0)))
    return F.round(F.least(F.lit(float(cap)), tilt), 12)


def solve_dual(sizes: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-7, most: int = 60) -> DataFrame:
    """``_source, _multiplier`` by Newton's method on every source's dual at once.

    Targets at the bounds (0, or cap times the source) have no finite multiplier; +-infinity stands for it.
    """
    small = targets.count() <= BROADCAST_SOURCES
    at_bound = F.when(F.col("_target") <= 0, F.lit(float("-inf"))).when(F.col("_target") >= cap * F.col("_words") * (1 - 1e-12), F.lit(float("inf")))
    state = targets.select(
        "_source", "_words", "_target", (F.col("_words") / F.col("_n")).alias("_mean"), F.coalesce(at_bound, F.lit(0.0)).alias("_multiplier"),
        F.lit(None).cast("double").alias("_low"), F.lit(None).cast("double").alias("_high"), at_bound.isNotNull().alias("_done"),
    )
    state = checkpoint(state)
    used = sizes.where("_size > 0")
    for _ in range(most):
        if state.where("NOT _done").isEmpty():
            break
        open_ = state.where("NOT _done").select("_source", "_mean", "_multiplier")
        rated = _same(used, open_, small).withColumn("_rate", _rate(F.col("_multiplier"), cap))
        words = F.col("_n") * F.col("_size") * F.col("_rate")
        slope = F.when(F.col("_rate") < cap, words * F.col("_size") / F.col("_mean")).otherwise(F.lit(0.0))
        sums = rated.groupBy("_source").agg(F.sum(words.cast("decimal(32,6)")).cast("double").alias("_sum"), F.sum(slope.cast("decimal(32,6)")).cast("double").alias("_slope"))
        m, gap = F.col("_multiplier"), F.col("_sum") - F.col("_target")
        step = _same(state, sums, small, "left")
        step = step.withColumn("_low", F.when(gap < 0, m).otherwise(F.col("_low"))).withColumn("_high", F.when(gap > 0, m).otherwise(F.col("_high")))
        newton = F.when(F.col("_slope") > 0, m - gap / F.col("_slope"))
        reach = F.greatest(F.lit(2.0), 2 * F.abs(m))  # how far a step may go where the bracket is open
        newton = F.least(F.greatest(F.coalesce(newton, F.when(gap < 0, m + reach).otherwise(m - reach)), m - reach), m + reach)
        middle = (F.col("_low") + F.col("_high")) / 2
        inside = (F.col("_low").isNull() | (newton > F.col("_low"))) & (F.col("_high").isNull() | (newton < F.col("_high")))
        moved = F.when(inside, newton).otherwise(F.coalesce(middle, newton))
        near = F.abs(gap) <= F.lit(tolerance) * F.col("_target")
        stuck = F.col("_high") - F.col("_low") <= 1e-13 * F.abs(m)
        done = F.col("_done") | F.coalesce(near, F.lit(True)) | F.coalesce(stuck, F.lit(False))
        state = checkpoint(step.select("_source", "_words", "_target", "_mean", F.when(done, m).otherwise(moved).alias("_multiplier"), "_low", "_high", done.alias("_done")))
    return state.select("_source", "_mean", "_multiplier")


def _copies() -> Column:
    """Copies of a bucket's documents, given as ``_docs`` sorted from long to short."""

    def step(acc, x):
        owed = acc["owed"] + x["part"] * x["size"]
        take = (x["size"] > 0) & (owed * 2 >= x["size"])
        return F.struct((owed - F.when(take, x["size"].cast("double")).otherwise(F.lit(0.0))).alias("owed"), F.concat(acc["extra"], F.array(F.when(take, 1).otherwise(0))).alias("extra"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<int>").alias("extra"))
    return F.aggregate("_docs", start, step, lambda acc: acc["extra"])


def _split_crowded(rated: DataFrame) -> DataFrame:
    """Adds ``_part``: 0, or in a crowded bucket one of as many parts as make it ordinary."""
    crowded = rated.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > CROWDED)
    crowded = checkpoint(crowded.select(F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), F.ceil(F.col("_rows") / BUCKET).alias("_parts")))
    right = F.broadcast(crowded) if crowded.count() <= BROADCAST_SOURCES else crowded
    joined = rated.join(right, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")), "left")
    return joined.withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")), F.lit(0))).drop("_s", "_b", "_parts")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """A row per input row: ``id_col, source_col, size, source_size, target, rate, copies, taken``, and its ``keep`` columns.

    ``weights`` go to the sources in code-point order, repeating; all targets together are ``share`` times
    all words; no document is rated above ``cap`` nor copied more than ``ceil(cap)`` times.
    """
    text = text_or_empty(text_col)
    kept = [F.struct(*keep).alias("_keep")] if keep else []
    rows = checkpoint(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text).alias("_size"), F.xxhash64(text).alias("_hash"), F.monotonically_increasing_id().alias("_row"), *kept))
    sizes = checkpoint(rows.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n")))
    targets = checkpoint(source_targets(sizes, weights, share, cap))
    solved = solve_dual(sizes, targets, cap)
    known = _same(targets, solved, False)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_n") / BUCKET))
    m = F.col("_multiplier")
    rate = F.when(m == float("inf"), F.lit(float(cap))).when(m == float("-inf"), F.lit(0.0)).otherwise(_rate(m, cap))
    rated = _same(rows, known, targets.count() <= BROADCAST_SOURCES).withColumn("_rate", F.when(F.col("_size") > 0, rate).otherwise(F.lit(0.0)))
    rated = _split_crowded(rated.withColumn("_bucket", F.pmod(F.xxhash64("_id", "_hash"), buckets)))
    whole = F.floor("_rate")
    entry = F.struct((-F.col("_size")).alias("_key"), F.col("_id").alias("id"), F.col("_size").alias("size"), F.col("_rate").alias("rate"), (F.col("_rate") - whole).alias("part"), "_hash", "_row", *(["_keep"] if keep else []))
    dealt = rated.groupBy("_source", "_bucket", "_part").agg(F.sort_array(F.collect_list(entry)).alias("_docs"), *[F.first(c).alias(c) for c in ("_words", "_target")])
    each = dealt.withColumn("_extra", _copies()).select("_source", "_words", "_target", F.explode(F.arrays_zip("_docs", "_extra")).alias("_x"))
    copies = (F.floor(F.col("_x._docs.rate")) + F.col("_x._extra")).cast("int")
    return each.select(
        F.col("_x._docs.id").alias(id_col), F.col("_source").alias(source_col), F.col("_x._docs.size").alias("size"), F.col("_words").alias("source_size"),
        F.col("_target").alias("target"), F.col("_x._docs.rate").alias("rate"), copies.alias("copies"), (copies * F.col("_x._docs.size")).alias("taken"),
        *[F.col(f"_x._docs._keep.{c}").alias(c) for c in keep],
    )
