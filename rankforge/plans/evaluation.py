"""Queries of retrieval evaluation. Relevant is what holds the passage; every document is ranked.

The position of the first relevant document is one more than the number of documents before it, so it is counted by an aggregate
and no ranking of all documents is made; metrics at k need the first 30 alone.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import ranking
from ..operators.keep import stored
from .common import qrels
from .fusion import SIGNALS, signals
from .registry import query

BY = ["query_id"]
#: Strategies by the signal that ranks.
STRATEGIES = {"embeddings": "emb", "keywords": "kw", "mrf": "mrf", "likelihood": "qlm"}
KS = [1, 3, 5, 10, 20, 30]


def long_scores(spark, sf):
    """``query_id, chunk_id, strategy, score``, stored: the four signals of every pair."""
    s = signals(spark, sf).select("query_id", "chunk_id", *[F.col(c).alias(name) for name, c in STRATEGIES.items()])
    return stored(s.unpivot(["query_id", "chunk_id"], list(STRATEGIES), "strategy", "score"), "long")


def first_relevant(long, rel):
    """``strategy, query_id, position`` of the queries of ``rel`` among all documents."""
    return ranking.first_position(long, rel, ["strategy", "query_id"])


QRELS = """rel AS MATERIALIZED (SELECT q.query_id, c.chunk_id FROM q JOIN c ON contains(c.text, q.text))"""
RANKED = f"""{SIGNALS}, {QRELS}, lng AS (SELECT query_id, chunk_id, unnest(['embeddings', 'keywords', 'mrf', 'likelihood']) AS strategy, unnest([emb, kw, mrf, qlm]) AS score FROM s),
    ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, strategy ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM lng)"""


@query("qrels", f"WITH q AS (SELECT item_id AS query_id, text FROM benchmark), c AS (SELECT doc_id AS chunk_id, text FROM documents), {QRELS} SELECT * FROM rel")
def relevant(spark, sf):
    return qrels(spark, sf)


def _metrics(name: str) -> str:
    return f"""{RANKED}, one AS (SELECT query_id, chunk_id, rank FROM ranked WHERE strategy = '{name}'), hits AS (SELECT one.query_id, rank FROM one JOIN rel USING (query_id, chunk_id)),
    nrel AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY ALL), grid AS (SELECT query_id, k, coalesce(n_rel, 0) AS n_rel FROM (SELECT DISTINCT query_id FROM one) LEFT JOIN nrel USING (query_id) CROSS JOIN (SELECT unnest({KS}) AS k)),
    per AS (SELECT g.query_id, g.k, any_value(n_rel) AS n_rel, count(rank) FILTER (WHERE rank <= g.k) AS hit, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= g.k), 0.0) AS dcg, min(rank) AS first FROM grid g LEFT JOIN hits ON hits.query_id = g.query_id GROUP BY g.query_id, g.k),
    m AS (SELECT query_id, k, CASE WHEN n_rel = 0 THEN 0.0 ELSE hit::DOUBLE / n_rel END AS recall, hit::DOUBLE / k AS precision,
        CASE WHEN n_rel = 0 THEN 0.0 ELSE dcg / list_sum(list_transform(range(1, least(n_rel, k) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg, coalesce(1.0 / first, 0.0) AS mrr FROM per),
    metrics AS (SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0.0 END AS f1 FROM m)"""


def metrics(spark, sf, *names):
    """Metrics of each of the strategies, from one table of scores."""
    long, rel = long_scores(spark, sf).where(F.col("strategy").isin(*names)), stored(qrels(spark, sf), "relevant")
    top = ranking.top_k(long, max(KS), ["query_id", "strategy"]).select("query_id", "strategy", "chunk_id", "rank")
    first = first_relevant(long, rel)
    made = [E.metrics_at_k(top.where(F.col("strategy") == n), rel, tuple(KS), first.where(F.col("strategy") == n).select("query_id", F.col("position").alias("first"))) for n in names]
    return made[0] if len(made) == 1 else made


_M = "recall precision ndcg mrr f1"


@query("metrics_at_k", f"WITH {_metrics('likelihood')} SELECT query_id, k::BIGINT AS k, recall, precision, ndcg, mrr, f1 FROM metrics", _M)
def metrics_at_k(spark, sf):
    return metrics(spark, sf, "likelihood")


@query("evaluate_reranker", f"WITH {_metrics('keywords')} SELECT query_id, k::BIGINT AS k, recall, precision, ndcg, mrr, f1 FROM metrics", _M)
def evaluate_reranker(spark, sf):
    return metrics(spark, sf, "keywords")


_AGG = """, lm AS (UNPIVOT (SELECT query_id, k, recall, precision, ndcg, f1, mrr FROM metrics) ON recall, precision, ndcg, f1, mrr INTO NAME metric VALUE value)
    SELECT k::BIGINT AS k, metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max FROM lm GROUP BY ALL"""


@query("metrics_aggregate", f"WITH {_metrics('likelihood')}{_AGG}", "mean std min max")
def metrics_aggregate(spark, sf):
    return E.metrics_aggregate(metrics(spark, sf, "likelihood"))


@query("evaluate_multiple", f"WITH {_metrics('mrf')}{_AGG}", "mean std min max")
def evaluate_multiple(spark, sf):
    return E.metrics_aggregate(metrics(spark, sf, "mrf"))


_IMPROVED = f""" {_metrics('likelihood')}, base AS (SELECT b.query_id, k, count(rank) FILTER (WHERE rank <= k)::DOUBLE / k AS precision FROM (SELECT DISTINCT query_id FROM ranked) b CROSS JOIN (SELECT unnest({KS}) AS k)
    LEFT JOIN (SELECT r.query_id, r.rank FROM ranked r JOIN rel USING (query_id, chunk_id) WHERE strategy = 'embeddings') h ON h.query_id = b.query_id GROUP BY b.query_id, k),
    im AS (SELECT query_id, k::BIGINT AS k, CASE WHEN base.precision > 0 THEN (metrics.precision - base.precision) / base.precision * 100 WHEN metrics.precision > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS change FROM metrics JOIN base USING (query_id, k))"""


@query("improvements", f"WITH {_IMPROVED} SELECT * FROM im", "change")
def improvements(spark, sf):
    """Change of precision against ranking by embeddings, in percent."""
    new, base = metrics(spark, sf, "likelihood", "embeddings")
    new, base = new.select("query_id", "k", F.col("precision").alias("new")), base.select("query_id", "k", F.col("precision").alias("base"))
    return new.join(base, ["query_id", "k"]).select("query_id", "k", E.improvement(F.col("new"), F.col("base")).alias("change"))


@query(
    "improvements_aggregate",
    f"WITH {_IMPROVED} SELECT k, count(*) AS n, count(*) FILTER (WHERE isfinite(change)) AS n_finite, avg(change) FILTER (WHERE isfinite(change)) AS mean, stddev_pop(change) FILTER (WHERE isfinite(change)) AS std, min(change) FILTER (WHERE isfinite(change)) AS min, max(change) FILTER (WHERE isfinite(change)) AS max FROM im GROUP BY k",
    "mean std min max",
)
def improvements_aggregate(spark, sf):
    """Over the queries whose change is finite: one from nothing to something has no percentage."""
    return E.improvements_aggregate(improvements(spark, sf))


POSITIONS = f"""{RANKED}, pos AS (SELECT st.strategy, r.query_id, min(k.rank) AS position, any_value(top.score) AS score FROM (SELECT DISTINCT query_id FROM rel) r CROSS JOIN (SELECT DISTINCT strategy FROM ranked) st
    LEFT JOIN (SELECT ranked.* FROM ranked JOIN rel USING (query_id, chunk_id)) k ON k.query_id = r.query_id AND k.strategy = st.strategy LEFT JOIN ranked top ON top.query_id = r.query_id AND top.strategy = st.strategy AND top.rank = 1 GROUP BY ALL)"""


def positions(spark, sf, long=None):
    """``strategy, query_id, position``: first relevant rank of every query that has something relevant."""
    return first_relevant(long_scores(spark, sf) if long is None else long, stored(qrels(spark, sf), "relevant"))


@query("expected_rank", f"WITH {POSITIONS} SELECT strategy, query_id, position FROM pos")
def expected_rank(spark, sf):
    return positions(spark, sf)


_TOP = """SELECT {by} count(*) AS n, avg(CASE WHEN position <= 1 THEN 1.0 ELSE 0.0 END) AS top1, avg(CASE WHEN position <= 3 THEN 1.0 ELSE 0.0 END) AS top3,
    avg(CASE WHEN position <= 5 THEN 1.0 ELSE 0.0 END) AS top5, avg(coalesce(1.0 / position, 0.0)) AS mrr FROM pos {group}"""


@query("topn_accuracy_mrr", f"WITH {POSITIONS} " + _TOP.format(by="strategy,", group="GROUP BY strategy"), "top1 top3 top5 mrr")
def topn_accuracy_mrr(spark, sf):
    return E.topn_accuracy(positions(spark, sf), ["strategy"])


@query("strategy_eval", f"WITH {POSITIONS} SELECT strategy, count(*) FILTER (WHERE position = 1) AS top1_correct, count(*) FILTER (WHERE position <= 5) AS top5_correct, count(*) AS n FROM pos GROUP BY strategy")
def strategy_eval(spark, sf):
    p = F.col("position")
    return positions(spark, sf).groupBy("strategy").agg(F.count(F.when(p == 1, 1)).alias("top1_correct"), F.count(F.when(p <= 5, 1)).alias("top5_correct"), F.count(F.lit(1)).alias("n"))


_LEAD = f"WITH {POSITIONS}, board AS ({_TOP.format(by='strategy,', group='GROUP BY strategy')})"


def board(spark, sf):
    return E.topn_accuracy(positions(spark, sf), ["strategy"])


@query("leaderboard_sort", f"{_LEAD} SELECT strategy, mrr, row_number() OVER (ORDER BY round(mrr, 6) DESC, strategy) AS rank FROM board", "mrr")
def leaderboard_sort(spark, sf):
    return ranking.rank_by(board(spark, sf).select(F.lit(1).alias("all"), "strategy", "mrr"), ["all"], "mrr", ["strategy"]).select("strategy", "mrr", "rank")


@query("best_config", f"{_LEAD} SELECT strategy, mrr FROM board ORDER BY round(mrr, 6) DESC, strategy LIMIT 1", "mrr")
def best_config(spark, sf):
    return ranking.best_config(board(spark, sf).select("strategy", "mrr"), "mrr", ["strategy"])


@query("top_models", f"{_LEAD} SELECT strategy, top5 FROM board WHERE strategy <> 'embeddings' ORDER BY round(top5, 6) DESC, strategy LIMIT 2", "top5")
def top_models(spark, sf):
    return board(spark, sf).where("strategy <> 'embeddings'").orderBy(F.round("top5", 6).desc(), "strategy").limit(2).select("strategy", "top5")


_CHANGE = "CASE WHEN base.{m} > 0 THEN (board.{m} - base.{m}) / base.{m} * 100 WHEN board.{m} > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS {m}_change"


@query("strategy_vs_baseline", f"{_LEAD} SELECT board.strategy, {_CHANGE.format(m='top1')}, {_CHANGE.format(m='top5')} FROM board CROSS JOIN (SELECT * FROM board WHERE strategy = 'embeddings') base", "top1_change top5_change")
def strategy_vs_baseline(spark, sf):
    b = board(spark, sf)
    base = b.where("strategy = 'embeddings'").select(F.col("top1").alias("_1"), F.col("top5").alias("_5"))
    return b.crossJoin(F.broadcast(base)).select("strategy", E.improvement(F.col("top1"), F.col("_1")).alias("top1_change"), E.improvement(F.col("top5"), F.col("_5")).alias("top5_change"))


#: Two languages stand in by the parity of the query's id.
_BY_LANG = f"""WITH {POSITIONS}, lp AS (SELECT strategy, CASE WHEN query_id % 2 = 0 THEN 'ca' ELSE 'es' END AS lang, position FROM pos),
    lb AS (SELECT strategy, lang, count(*) AS n, avg(CASE WHEN position <= 1 THEN 1.0 ELSE 0.0 END) AS top1, avg(CASE WHEN position <= 3 THEN 1.0 ELSE 0.0 END) AS top3, avg(1.0 / position) AS mrr, avg(position) AS position FROM lp GROUP BY ALL)"""


def by_language(spark, sf):
    """``strategy, lang, n, top1, top3, mrr, position``, stored."""
    p = positions(spark, sf).withColumn("lang", F.when(F.col("query_id") % 2 == 0, "ca").otherwise("es"))
    share = lambda k: F.avg(F.when(F.col("position") <= k, 1.0).otherwise(0.0)).alias(f"top{k}")
    return stored(p.groupBy("strategy", "lang").agg(F.count(F.lit(1)).alias("n"), share(1), share(3), F.avg(1 / F.col("position")).alias("mrr"), F.avg("position").alias("position")), "languages")


@query("strategy_summary", f"{_LEAD} SELECT CASE WHEN strategy = 'embeddings' THEN 'dense' ELSE 'lexical' END AS family, count(*) AS n, max(mrr) AS max_mrr, min(mrr) AS min_mrr, avg(mrr) AS mean_mrr, max(top1) AS max_top1 FROM board GROUP BY ALL", "max_mrr min_mrr mean_mrr max_top1")
def strategy_summary(spark, sf):
    """A row for each family of strategies: methods, best, worst and mean MRR, best top-1."""
    family = F.when(F.col("strategy") == "embeddings", "dense").otherwise("lexical").alias("family")
    return board(spark, sf).groupBy(family).agg(F.count(F.lit(1)).alias("n"), F.max("mrr").alias("max_mrr"), F.min("mrr").alias("min_mrr"), F.avg("mrr").alias("mean_mrr"), F.max("top1").alias("max_top1"))


@query("weighted_mean_by_config", f"{_BY_LANG} SELECT strategy, sum(top1 * n) / sum(n) AS top1, sum(top3 * n) / sum(n) AS top3, sum(mrr * n) / sum(n) AS mrr FROM lb GROUP BY strategy", "top1 top3 mrr")
def weighted_mean_by_config(spark, sf):
    """Both languages' metrics weighed by their questions, for each configuration."""
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return by_language(spark, sf).groupBy("strategy").agg(mean("top1"), mean("top3"), mean("mrr"))


@query("config_rank_lang_avg", f"{_BY_LANG} SELECT strategy, top1, row_number() OVER (ORDER BY round(top1, 6) DESC, strategy) AS rank, top1 >= 1 AS reached FROM (SELECT strategy, avg(top1) AS top1 FROM lb GROUP BY strategy)", "top1")
def config_rank_lang_avg(spark, sf):
    """Mean of the languages' top-1 by configuration, best first; ``reached`` where it is 100 %."""
    mean = by_language(spark, sf).groupBy("strategy").agg(F.avg("top1").alias("top1")).withColumn("all", F.lit(1))
    return ranking.rank_by(mean, ["all"], "top1", ["strategy"]).select("strategy", "top1", "rank", (F.col("top1") >= 1).alias("reached"))


@query("model_leaderboard_stats", f"{_LEAD} SELECT count(*) FILTER (WHERE round(mrr, 6) > (SELECT round(mrr, 6) FROM board WHERE strategy = 'embeddings')) AS better, max(mrr) - min(mrr) AS range, avg(mrr) AS mean FROM board WHERE strategy <> 'embeddings'", "range mean")
def model_leaderboard_stats(spark, sf):
    b = board(spark, sf).select("strategy", "mrr")
    base = b.where("strategy = 'embeddings'").select(F.round("mrr", 6).alias("_base"))
    return b.where("strategy <> 'embeddings'").crossJoin(F.broadcast(base)).agg(F.count(F.when(F.round("mrr", 6) > F.col("_base"), 1)).alias("better"), (F.max("mrr") - F.min("mrr")).alias("range"), F.avg("mrr").alias("mean"))


@query("improvement_votes", f"""{_BY_LANG} SELECT lb.strategy, 100.0 * sum((round(lb.top1, 6) > round(base.top1, 6))::INT + (round(lb.top3, 6) > round(base.top3, 6))::INT + (round(lb.mrr, 6) > round(base.mrr, 6))::INT + (round(lb.position, 6) < round(base.position, 6))::INT) / 8 AS votes
    FROM lb JOIN (SELECT * FROM lb WHERE strategy = 'embeddings') base USING (lang) GROUP BY lb.strategy""", "votes")
def improvement_votes(spark, sf):
    """Of eight comparisons with the baseline (top-1, top-3, MRR and mean position in two languages), the share improved, in percent."""
    b = by_language(spark, sf)
    names = ["top1", "top3", "mrr", "position"]
    base = b.where("strategy = 'embeddings'").select("lang", *[F.round(c, 6).alias(f"_{c}") for c in names])
    better = sum(((F.round(c, 6) < F.col(f"_{c}") if c == "position" else F.round(c, 6) > F.col(f"_{c}")).cast("int") for c in names), F.lit(0))
    return b.join(F.broadcast(base), "lang").groupBy("strategy").agg((100.0 * F.sum(better) / 8).alias("votes"))


MODEL = """SELECT strategy, avg(CASE WHEN p = 1 THEN 1.0 ELSE 0.0 END) AS acc1, avg(CASE WHEN p <= 5 THEN 1.0 ELSE 0.0 END) AS acc5, avg(coalesce(1.0 / p, 0.0)) AS mrr, avg(coalesce(1.0 / p, 0.0)) AS map, avg(coalesce(1 / log2(p + 1), 0.0)) AS ndcg5,
    coalesce(avg(CASE WHEN p IS NOT NULL THEN score END), 0.0) AS mean_similarity, count(*) FILTER (WHERE p IS NULL) AS not_found FROM (SELECT strategy, score, CASE WHEN position <= 5 THEN position END AS p FROM pos) GROUP BY strategy"""


@query("model_metrics", f"WITH {POSITIONS} {MODEL}", "acc1 acc5 mrr map ndcg5 mean_similarity")
def model_metrics(spark, sf):
    long = long_scores(spark, sf)
    first = ranking.top_k(long, 1, ["strategy", "query_id"]).select("strategy", "query_id", "score")
    p = positions(spark, sf, long).join(first, ["strategy", "query_id"], "left")
    p = p.withColumn("position", F.when(F.col("position") <= 5, F.col("position")))
    return E.model_metrics(p.withColumn("score", F.when(F.col("position").isNotNull(), F.col("score"))), ["strategy"])
