"""Queries of weights that follow earlier queries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..operators import fusion as N
from ..operators import learning
from ..operators import retrieval as R
from ..operators.keep import fresh_path, stored
from ..streaming import history
from .evaluation import POSITIONS, positions
from .fusion import _other_mrf, found, ranked_sql, retrieval
from .lexical import ENSEMBLE
from .registry import query
from .text import PATTERN_SQL, patterns


def known_patterns(spark):
    """Every pattern: ``pattern, group, has_medical, has_question, has_technical``."""
    word = lambda flag, name: name if flag else "no_" + name
    rows = [("_".join((g, word(m, "med"), word(q, "q"), word(t, "tech"))), g, m, q, t) for g, m, q, t in product(learning.GROUP_LENGTH, *[(True, False)] * 3)]
    return spark.createDataFrame(rows, "pattern string, group string, " + ", ".join(f"{c} boolean" for c in learning.FLAGS)).coalesce(1)


_SIMILAR = f"""ft AS MATERIALIZED ({PATTERN_SQL}),
    kp AS (SELECT g || '_' || CASE WHEN m THEN 'med' ELSE 'no_med' END || '_' || CASE WHEN k THEN 'q' ELSE 'no_q' END || '_' || CASE WHEN t THEN 'tech' ELSE 'no_tech' END AS pattern, len, m, k, t
        FROM (VALUES ('short', 3), ('medium', 6), ('long', 10)) g(g, len) CROSS JOIN (VALUES (true), (false)) m(m) CROSS JOIN (VALUES (true), (false)) k(k) CROSS JOIN (VALUES (true), (false)) t(t)),
    ps AS MATERIALIZED (SELECT query_id, kp.pattern, 0.4 * (1 - abs(n_words - len)::DOUBLE / greatest(n_words, len, 1)) + 0.4 * ((has_medical = m)::INT + (has_question = k)::INT + (has_technical = t)::INT) / 3.0
        + 0.2 * (1 - abs(mean_length - 5.0) / greatest(mean_length, 5.0, 1.0)) AS similarity FROM ft CROSS JOIN kp)"""


@query("pattern_similarity", f"WITH {_SIMILAR} SELECT * FROM ps", "similarity")
def pattern_similarity(spark, sf):
    """Each query against every pattern."""
    return learning.pattern_similarity(patterns(spark, sf), known_patterns(spark))


def success(spark, sf):
    """``query_id, mrf, emb``: whether the model alone puts something relevant first."""
    one = lambda name: F.max(F.when((F.col("strategy") == name) & (F.col("position") == 1), 1).otherwise(0))
    return positions(spark, sf).groupBy("query_id").agg(one("mrf").alias("mrf"), one("embeddings").alias("emb"))


_HISTORY = f"""{_SIMILAR}, ok AS (SELECT query_id, max((strategy = 'mrf' AND position = 1)::INT) AS mrf, max((strategy = 'embeddings' AND position = 1)::INT) AS emb FROM pos GROUP BY query_id),
    hs AS (SELECT a.query_id, a.pattern, e.query_id AS earlier, coalesce(ok.mrf, 0) AS mrf, coalesce(ok.emb, 0) AS emb, row_number() OVER (PARTITION BY a.query_id, a.pattern ORDER BY e.query_id DESC) AS r
        FROM ps a JOIN ft e ON e.pattern = a.pattern AND e.query_id < a.query_id LEFT JOIN ok ON ok.query_id = e.query_id WHERE a.similarity > 0.7),
    hw AS (SELECT ft.query_id, count(hs.r) AS n_similar, least(0.8, greatest(0.2, CASE WHEN coalesce(sum(mrf + emb), 0) = 0 THEN 0.5 ELSE sum(mrf)::DOUBLE / sum(mrf + emb) END)) AS m, least(0.8, greatest(0.2, CASE WHEN coalesce(sum(mrf + emb), 0) = 0 THEN 0.5 ELSE sum(emb)::DOUBLE / sum(mrf + emb) END)) AS e
        FROM ft LEFT JOIN hs ON hs.query_id = ft.query_id AND hs.r <= 10 GROUP BY ft.query_id)"""


@query("history_weights", f"WITH {POSITIONS}, {_HISTORY} SELECT query_id, n_similar, m / (m + e) AS mrf_weight, e / (m + e) AS emb_weight FROM hw", "mrf_weight emb_weight")
def history_weights(spark, sf):
    return learning.history_weights(stored(patterns(spark, sf), "patterns"), known_patterns(spark), success(spark, sf))


@query("learning_history_stream", f"WITH {POSITIONS}, {_HISTORY} SELECT query_id, n_similar, m / (m + e) AS mrf_weight, e / (m + e) AS emb_weight FROM hw", "mrf_weight emb_weight")
def learning_history_stream(spark, sf):
    """The same weights from a stream: queries come in the order of their ids, each followed by its feedback; two batches share their state."""
    folder = fresh_path(spark, "history")
    made = stored(patterns(spark, sf).join(success(spark, sf), "query_id", "left").fillna(0, ["mrf", "emb"]), "history")
    flags = [F.col(c) for c in learning.FLAGS]
    asks = made.select(F.lit("all").alias("scope"), (2 * F.col("query_id")).alias("seq"), F.lit("query").alias("kind"), "query_id", "pattern", F.col("n_words").cast("int").alias("n_words"), "mean_length", *flags, F.lit(None).cast("int").alias("mrf"), F.lit(None).cast("int").alias("emb"))
    tells = made.select(F.lit("all").alias("scope"), (2 * F.col("query_id") + 1).alias("seq"), F.lit("feedback").alias("kind"), "query_id", "pattern", F.lit(None).cast("int").alias("n_words"), F.lit(None).cast("double").alias("mean_length"), *[F.lit(None).cast("boolean").alias(c) for c in learning.FLAGS], F.col("mrf").cast("int").alias("mrf"), F.col("emb").cast("int").alias("emb"))
    events = stored(asks.unionByName(tells), "events")
    middle = 2 * ((made.agg(F.max("query_id")).first()[0] or 0) // 2)
    known = [tuple(r) for r in known_patterns(spark).collect()]  # 24 rows
    before = spark.conf.get(history.STORE[0], None)
    for part in (F.col("seq") < middle, F.col("seq") >= middle):
        events.where(part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(history.EVENTS).parquet(f"{folder}/in")
        history.run(stream, known, lambda df, i: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/state").awaitTermination()
    if before is None:
        spark.conf.unset(history.STORE[0])
    else:
        spark.conf.set(history.STORE[0], before)
    return spark.read.schema("scope string, query_id long, n_similar long, mrf_weight double, emb_weight double").parquet(f"{folder}/out").drop("scope")


_LEARNT = """lw AS (SELECT query_id, CASE WHEN n_similar > 0 THEN 0.5 WHEN n_words <= 3 THEN 0.4 WHEN n_words <= 6 THEN 0.5 WHEN n_words <= 10 THEN 0.7 ELSE 0.8 END AS wm, CASE WHEN n_similar > 0 THEN 0.5 WHEN n_words <= 3 THEN 0.6 WHEN n_words <= 6 THEN 0.5 WHEN n_words <= 10 THEN 0.3 ELSE 0.2 END AS we
        FROM (SELECT ft.query_id, any_value(ft.n_words) AS n_words, count(e.query_id) AS n_similar FROM ft LEFT JOIN ps a ON a.query_id = ft.query_id AND a.similarity > 0.7 LEFT JOIN ft e ON e.pattern = a.pattern AND e.query_id < ft.query_id GROUP BY ft.query_id)),
    ls AS (SELECT query_id, chunk_id, wm * mrf + we * CASE WHEN v.v IS NULL THEN 0.0 ELSE emb END AS total FROM s2 JOIN lw USING (query_id) LEFT JOIN v ON v.vec_id = chunk_id)"""


@query("search_mrf_emb_learning", f"WITH {_other_mrf('ensemble', ENSEMBLE, 4, 6, 8, 10, 12)}, {_SIMILAR}, {_LEARNT} {ranked_sql('total', 'ls', 5)}", "score")
def search_mrf_emb_learning(spark, sf):
    """Ensemble and embedding with even weights once an earlier query was similar (successes are never reported back, so no
    history tips them), else with weights by the query's length; queries come in the order of their ids."""
    features = stored(patterns(spark, sf), "patterns")
    none = features.select("query_id", F.lit(0).alias("mrf"), F.lit(0).alias("emb"))
    m, e = N.adaptive_weights(F.col("n_words"))
    seen = F.col("n_similar") > 0
    weights = learning.history_weights(features, known_patterns(spark), none).join(features.select("query_id", "n_words"), "query_id")
    weights = weights.select("query_id", F.when(seen, F.col("mrf_weight")).otherwise(m).alias("wm"), F.when(seen, F.col("emb_weight")).otherwise(e).alias("we"))

    def score(signals, queries):
        return queries.extra["wm"][:, None] * signals["mrf"] + queries.extra["we"][:, None] * signals["emb"] * signals["has"]

    return found(retrieval(spark, sf, weights).top(5, score, ["mrf", "emb", "has"], R.ensemble_mixture, rising="mrf"))
