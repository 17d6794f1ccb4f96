"""Sub-words and places of words against plain loops over whole texts."""

import json
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rankforge.functions.text import tokenize
from rankforge.operators import subwords as S

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
SHARDS = ["the", "Àvia", "informació", "x" * 90, "naïve", "é", "日本語", "don't", "(a)", "1234", "\n", " \t ", "😀", "medication", "Ġ", "_", "…", "straße"]


def pieces(path):
    """The vocabulary's whole-character pieces, as two sets."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back, n = {}, 0
    for b in range(256):
        if b in keep:
            back[chr(b)] = b
        else:
            back[chr(256 + n)] = b
            n += 1
    start, rest = set(), set()
    for p in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        if all(c in back for c in p):
            try:
                t = bytes(back[c] for c in p).decode()
            except UnicodeDecodeError:
                continue
            if t[0] == " ":
                start.add(t[1:])
            else:
                rest.add(t)
    return start - {""}, rest


@pytest.fixture(scope="module")
def vocabulary():
    return pieces(PATH)


def cut(text, vocabulary):
    start, rest = vocabulary
    out = []
    for m in re.finditer(r"\w+|[^\w\s]", text):
        word, at, own = m.group(), 0, start
        while at < len(word):
            n = next((n for n in range(len(word) - at, 0, -1) if word[at : at + n] in own), 1)
            out.append((m.start() + at, m.start() + at + n))
            at, own = at + n, rest
    return out


def texts(n=60):
    rnd = random.Random(3)
    made = ["".join(rnd.choice(SHARDS) + rnd.choice(["", " ", " "]) for _ in range(rnd.randrange(0, 400))) for _ in range(n)]
    return made + ["", None, "one", "word " * 19, "word " * 20, "word " * 128, "word " * 129, "word " * 384, "word " * 385, "palabra " * 30_000]


def test_offsets_equal_a_plain_loop(spark, vocabulary):
    rows = list(enumerate(texts()))
    made = {r.chunk_id: r for r in S.piece_offsets(spark.createDataFrame(rows, "chunk_id long, text string").repartition(3), PATH).collect()}
    for i, t in rows:
        assert list(zip(made[i].begins, made[i].ends)) == cut(t or "", vocabulary)


def test_windows_equal_a_plain_loop(spark, vocabulary):
    rows = list(enumerate(texts()))
    df = S.piece_offsets(spark.createDataFrame(rows, "chunk_id long, text string"), PATH)
    for size, shared in ((384, 128), (50, 10)):
        want = set()
        for i, t in rows:
            own = cut(t or "", vocabulary)
            if len(own) < 20:
                continue
            step = size - shared
            total = max(1, (len(own) - shared) // step)
            for k, at in enumerate(range(0, len(own) - shared, step)):
                part = own[at : at + size]
                text = t[part[0][0] : part[-1][1]]
                if len(part) >= 20 and len(text.split()) >= 20:
                    want.add((i, k, total, round(at / len(own), 9), len(part), part[0][0], part[-1][1], text))
        got = S.subword_windows(df, size, shared).withColumn("rel_position", F.round("rel_position", 9)).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_places_of_words(spark):
    rows = [(0, "Dolor, dolor; DOLOR_x dolorós"), (1, ""), (2, None), (3, "pain\npain pain"), (4, "a dolor")]
    queries = spark.createDataFrame([(0, "Dolor dolor de pain"), (50, "nothing"), (100, None)], "query_id long, text string")
    words = queries.select(F.explode(tokenize(F.col("text"))).alias("word"))
    places = S.word_places(spark.createDataFrame(rows, "chunk_id long, text string"), words)
    got = {(r.query_id, r.chunk_id, r.word): (r["count"], round(r.frequency, 9), list(r.places)) for r in S.keyword_places(queries, places, tokenize(F.col("text"))).collect()}
    want = {}
    for c, t in rows:
        low = (t or "").lower()
        for w in {"dolor", "pain"}:
            at = [m.start() for m in re.finditer(rf"\b{w}\b", low)]
            if at:
                want[0, c, w] = (len(at), round(len(at) / len(low.split()), 9), at)
    assert got == want
