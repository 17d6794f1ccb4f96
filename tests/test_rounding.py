"""Orders by a rounded score, and thresholds, fall where the SQL's arithmetic puts them."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from rankforge.operators import learning, ranking, retrieval
from rankforge.streaming import history


def test_halves_are_rounded_as_in_sql(spark):
    units = np.random.default_rng(3).integers(40_000_000, 160_000_000, 4000)
    x = np.array([float(f"-{k // 1_000_000}.{k % 1_000_000:06d}5") for k in units.tolist()])  # nine digits, a half at the sixth
    con = duckdb.connect()
    wanted = np.array([r[0] for r in con.execute("SELECT round(x, 6) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [x.tolist()]).fetchall()])
    assert (np.round(x, 6) != wanted).any()
    rows = [(0, 2 * i, float(v)) for i, v in enumerate(x)] + [(0, 2 * i + 1, float(w)) for i, w in enumerate(wanted)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id int, score double")
    con.execute("CREATE TABLE t AS SELECT unnest(?::INT[]) AS chunk_id, unnest(?::DOUBLE[]) AS score", [[r[1] for r in rows], [r[2] for r in rows]])
    own = {(r["chunk_id"], r["rank"]) for r in ranking.rank_all(df, ["query_id"]).collect()}
    assert own == set(con.execute("SELECT chunk_id, row_number() OVER (ORDER BY round(score, 6) DESC, chunk_id) FROM t").fetchall())
    assert (retrieval._six(x) == wanted).all() and (retrieval._six(-x) == -wanted).all()


def test_a_similarity_on_the_threshold(spark):
    """Three equal flags are 1.2 / 3 in the SQL; in doubles 34 words of mean length 155 / 34 came to 0.7000000000000001."""
    features = [(i, n, m, a, b, c) for i, (n, m, a, b, c) in enumerate((n, m, a, b, c) for n in range(1, 40) for m in (3.0, 155 / 34, 5.0, 6.25, 8.0) for a in (False, True) for b in (False, True) for c in (False, True))]
    kinds = "query_id int, n_words int, mean_length double, has_medical boolean, has_question boolean, has_technical boolean"
    df = spark.createDataFrame(features, kinds).withColumn("pattern", F.lit(""))
    known = [(f"{g}{m}{q}{t}", g, m, q, t) for g in learning.GROUP_LENGTH for m in (True, False) for q in (True, False) for t in (True, False)]
    patterns = spark.createDataFrame(known, "pattern string, group string, has_medical boolean, has_question boolean, has_technical boolean")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE ft ({kinds.replace('string', 'VARCHAR')})".replace("query_id int", "query_id INT"))
    con.executemany("INSERT INTO ft VALUES (?, ?, ?, ?, ?, ?)", features)
    con.execute('CREATE TABLE kp (pattern VARCHAR, "group" VARCHAR, m BOOLEAN, k BOOLEAN, t BOOLEAN)')
    con.executemany("INSERT INTO kp VALUES (?, ?, ?, ?, ?)", known)
    sql = """SELECT query_id, kp.pattern FROM ft CROSS JOIN (SELECT *, CASE "group" WHEN 'short' THEN 3 WHEN 'medium' THEN 6 ELSE 10 END AS len FROM kp) kp WHERE 0.4 * (1 - abs(n_words - len)::DOUBLE / greatest(n_words, len, 1))
        + 0.4 * ((has_medical = m)::INT + (has_question = k)::INT + (has_technical = t)::INT) / 3.0 + 0.2 * (1 - abs(mean_length - 5.0) / greatest(mean_length, 5.0, 1.0)) > 0.7"""
    wanted = set(con.execute(sql).fetchall())
    assert {tuple(r) for r in learning.pattern_similarity(df, patterns).where("similarity > 0.7").select("query_id", "pattern").collect()} == wanted
    assert {tuple(r) for r in df.select("query_id", F.explode(history.similar(known))).collect()} == wanted
