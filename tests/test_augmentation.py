"""Variations of texts against plain Python with the same draws, and their evaluation against a loop."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankforge.functions import augment as A
from rankforge.plans import augmentation, registry


def draw(options, *key):
    return options[int(hashlib.md5("/".join(key).encode()).hexdigest()[:6], 16) % len(options)]


def replaced(text, key, table, label):
    for word, options in table.items():
        other = draw(options, key, label, word)
        text = text.replace(word, other).replace(word.capitalize(), other[0].upper() + other[1:])
    return text


def reordered(text, key, label):
    parts = text.split(". ")
    return ". ".join(p for _, p in sorted((hashlib.md5(f"{key}/{label}/{i}".encode()).hexdigest(), p) for i, p in enumerate(parts)))


def plain_paraphrases(text, key, n):
    made = [replaced(text, key, A.TERMS, f"term{i}") for i in range(n)] + [reordered(text, key, f"order{i}") for i in range(min(2, n))] + [replaced(text, key, A.QUESTION_WORDS, f"word{i}") for i in range(min(2, n))]
    return list(dict.fromkeys([text, *made]))[: n + 1]


def plain_contexts(text, key, n):
    opened = [draw(A.OPENINGS, key, f"context{i}") + text for i in range(min(2, n))]
    asked = [x + text.lower() for x in A.INDIRECT] if text.endswith("?") else [a + (text if k == 0 else text.lower()) + b for k, (a, b) in enumerate(A.DIRECT)]
    return list(dict.fromkeys([text, *opened, *asked]))[: n + 1]


TEXTS = [
    "El paciente toma el medicamento. Paciente en domicilio. Se revisa el diagnóstico.", "¿Cómo se administra el tratamiento en casa?", "Sin nada que cambiar", "", "a. b. c. d. e", "Cuidado y cuidado del Paciente. qué hacer y dónde",
    "medicamento " * 2000, "Domicilio", "x?",
]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_variations_against_plain_python(spark, n):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    key = F.col("id").cast("string")
    for r in rows.select("id", A.paraphrases(F.col("text"), key, n).alias("p"), A.contexts(F.col("text"), key, n).alias("c")).collect():
        assert r["p"] == plain_paraphrases(TEXTS[r["id"]], str(r["id"]), n)
        assert r["c"] == plain_contexts(TEXTS[r["id"]], str(r["id"]), n)


def _tables(spark, folder, docs, benchmark):
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_corpus_names_and_evaluation(spark, tmp_path):
    passage = "la hospitalización en domicilio requiere que el paciente tenga cuidado de una persona"
    docs = [(1, f"Antes de todo {passage} y sigue.", "a"), (2, "El medicamento se guarda. En frío siempre.", "a"), (3, None, None), (4, f"otra vez, {passage}. Fin del texto", "b")]
    _tables(spark, tmp_path, docs, [(0, passage), (1, "el medicamento se guarda")])
    made = augmentation.corpus(spark, str(tmp_path)).collect()
    want = []
    for i, text, _ in docs:
        text = text or ""
        want += [(i, v, f"doc{i} ({'Original' if v == 0 else f'Paráfrasis {v}'})", x) for v, x in enumerate(plain_paraphrases(text, str(i), 2))]
        want += [(i, v + 5, f"doc{i} (Contexto {v})", x) for v, x in enumerate(plain_contexts(text, str(i), 1)) if v]
    assert sorted(map(tuple, made)) == sorted(want)

    import regex

    toks = lambda t: regex.findall(r"[\p{L}\p{N}_]+", t.lower())
    tf = {(i, v): Counter(toks(x)) for i, v, _, x in want}
    cf, total = Counter(), sum(sum(c.values()) for c in tf.values())
    for c in tf.values():
        cf.update(c)
    places = []
    for q in (passage, "el medicamento se guarda"):
        got = registry.queries()["augmented_eval"](spark, str(tmp_path)).first()
        terms = toks(q)
        # A text without tokens has a likelihood of 0, before all others; each factor is 1e-6 at least.
        score = lambda k: sum(math.log(max((tf[k][t] + 1500 * cf[t] / total) / (sum(tf[k].values()) + 1500), 1e-6)) for t in terms) if tf[k] else 0.0
        order = sorted(tf, key=lambda k: (-round(score(k), 6), k[0] * 10 + k[1]))
        relevant = {i for i, text, _ in docs if text and q in text}
        if relevant:
            places.append(1 + next(p for p, k in enumerate(order) if k[0] in relevant))
    assert got["n"] == len(places) and got["mrr"] == pytest.approx(sum(1 / p for p in places) / len(places), abs=1e-6)
    assert got["top1"] == pytest.approx(sum(p == 1 for p in places) / len(places), abs=1e-6)


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [], [])
    assert augmentation.corpus(spark, str(tmp_path)).count() == 0
    assert registry.queries()["augmented_eval"](spark, str(tmp_path)).first()["n"] == 0


def test_first_relevant_place_without_a_table_of_scores(spark, monkeypatch):
    """Counted where the documents are, over several sets of queries and blocks; against the ranks of all scores."""
    import random

    from pyspark.sql import functions as F

    from rankforge.operators import lexical, retrieval
    from rankforge.operators.ranking import first_position

    rng = random.Random(3)
    docs = [(i, [f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 9))]) for i in range(120)] + [(200, ["w1", "w2"]), (201, ["w1", "w2"])]
    queries = [(q, [f"w{rng.randrange(14)}" for _ in range(3)]) for q in range(7)] + [(7, ["w1"]), (8, ["zz"])]
    rel = [(q, d) for q in range(7) for d in rng.sample(range(120), 3)] + [(7, 201), (8, 5)]
    d, q = spark.createDataFrame(docs, "chunk_id long, tokens array<string>").repartition(3), spark.createDataFrame(queries, "query_id long, tokens array<string>")
    relevant = spark.createDataFrame(rel, "query_id long, chunk_id long")
    want = {r.query_id: r.position for r in first_position(lexical.qlm_dirichlet(lexical.Index(q, d)), relevant, ["query_id"]).collect()}
    monkeypatch.setattr(retrieval, "SET_TERMS", 9)
    monkeypatch.setattr(retrieval, "BLOCK_PAIRS", 64)
    wanted = relevant.groupBy("chunk_id").agg(F.collect_set("query_id").alias("wanted"))
    got = retrieval.Retrieval(q.withColumn("n_words", F.lit(0)), d).first_position(d.join(wanted, "chunk_id"))
    assert {r.query_id: r.position for r in got.collect()} == want and len(want) == 9
