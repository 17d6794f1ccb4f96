"""The corpus pipeline, stage by stage against plain Python, over rows that are toxic, copied, near, repeated, null and empty."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row int, component string"
BAD = "you vile rotter and miserable knave"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words((t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    lexicon = [f"word{i}" for i in range(700)]
    prose = lambda n: " ".join(lexicon[i] for i in rng.integers(0, 700, n))
    texts = [prose(int(rng.integers(20, 160))) for _ in range(120)]
    rows = list(enumerate(texts))
    rows += [(200 + i, f"{prose(30)} {BAD} {prose(20)}") for i in range(40)]
    rows += [(300 + i, texts[i % 7].replace(" ", "  " if i % 2 else " ")) for i in range(60)]
    for i in range(50):
        own = texts[20 + i % 10].split()
        own[int(rng.integers(0, len(own)))] = f"edit{i}"
        rows.append((400 + i, " ".join(own)))
    rows += [(500, None), (501, ""), (502, " \n"), (None, prose(40)), (None, texts[3]), (None, None), (600, "short"), (600, prose(25)), (600, prose(25)), (601, "one two"), (601, "one two"), (5, prose(33)), (700, prose(3000))]
    full = [(i, t, "en", None if k % 11 == 5 else f"s{k % 4}", len(t or ""), "clash", k, "clash") for k, (i, t) in enumerate(rows)]
    where = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(full, SCHEMA).repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(200 <= i < 240)) for i in range(0, 240, 2)] + [(200, 0), (9999, 1), (None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, every = docs.columns, {r["_row"]: r for r in docs.collect()}
    out = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        out.append([r["_row"] for r in docs.collect()])
    clean, single, apart, mixed = out
    assert sorted(clean) == sorted(k for k, r in every.items() if BAD not in (r["text"] or ""))

    norm = {k: re.sub(r"[\x20\x09-\x0D]+", " ", every[k]["text"] or "") for k in clean}
    least = {}
    for k in clean:
        if every[k]["doc_id"] is not None:
            least[norm[k]] = min(every[k]["doc_id"], least.get(norm[k], every[k]["doc_id"]))
    assert sorted(single) == sorted(k for k in clean if every[k]["doc_id"] == least.get(norm[k]))

    named = [k for k in single if every[k]["doc_id"] is not None]
    sets = {k: shingles(every[k]["text"]) for k in named}
    near = {k: [j for j in named if len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])] for k in named}
    group = {k: every[k]["doc_id"] for k in named}
    for _ in range(8):
        group = {k: min(group[j] for j in near[k]) for k in named}
    assert sorted(apart) == sorted(k for k in single if k not in group or every[k]["doc_id"] == group[k]) and len(apart) < len(single) - 30

    times = Counter(mixed)
    size = {k: len(words(every[k]["text"])) for k in apart}
    assert set(times) <= set(apart) and max(times.values()) <= 2 and all(size[k] for k in times)
    by = defaultdict(list)
    for k in apart:
        by[every[k]["source"]].append(k)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    target, open_ = {}, list(order)
    left = 1.5 * sum(size.values())
    while True:  # reshare until none is above twice its source
        weight = {s: (5, 2, 1)[order.index(s) % 3] for s in open_}
        share = {s: left * weight[s] / sum(weight.values()) for s in open_}
        full = [s for s in open_ if share[s] > 2 * sum(size[k] for k in by[s])]
        target |= {s: min(share[s], 2 * sum(size[k] for k in by[s])) for s in (full or open_)}
        if not full:
            break
        left -= sum(target[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    for s, own in by.items():
        assert abs(sum(times[k] * size[k] for k in own) - target[s]) <= max(size[k] for k in own)

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    pieces, sequences = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect(), defaultdict(list)
    ids = {k: [*lib.encode(every[k]["text"] or "", add_special_tokens=False).ids, 1] for k in times}
    whole = Counter()
    for r in pieces:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]] += r["length"]
    want = Counter()
    for k, n in times.items():
        want[every[k]["doc_id"]] += n * len(ids[k])
    assert whole == want
    sums = {(every[k]["doc_id"], zlib.crc32(np.array(ids[k][a : a + n], "<u4").tobytes())) for k in times for a, n in {(r["start"], r["length"]) for r in pieces if r["doc_id"] == every[k]["doc_id"]}}
    assert all((r["doc_id"], r["ids_crc32"]) in sums for r in pieces)
    for own in sequences.values():
        own.sort()
        total = sum(n for _, n in own)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and total <= 2048 and total & (total - 1) == 0


def test_empty_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    spark.read.parquet(f"{folder}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    some = spark.read.parquet(f"{folder}/documents.parquet").where("_row < 5")
    assert corpus_pipeline.toxicity(spark, some, str(tmp_path)).count() == 5


#: Names that the stages use inside.
INNER = ["copies", "taken", "rate", "size", "source_size", "target", "_mix_row", "_mix_copies", "_mix_row_", "_mixed", "_near_row", "_near_row_", "_keep", "_text", "_lost", "_hash", "_source", "_size", "kept", "keep_id", "_name", "_n", "_least", "node", "a", "b", "_key", "words", "toxic", "label", "score", "grade", "_fp"]


def test_stages_with_clashing_columns(spark, folder):
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    have = {c.lower() for c in plain.columns}
    clash = plain.select("*", *[F.lit(i).alias(n) for i, n in enumerate(INNER) if n not in have])
    rows = lambda df: sorted(df.select(*plain.columns).collect(), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, clash = (corpus_pipeline.stored(stage(spark, df, folder), name) for df in (plain, clash))
        assert rows(plain) == rows(clash) and len(clash.columns) > len(INNER), name
    a, b = (corpus_pipeline.packing(spark, df, folder) for df in (plain, clash))
    assert a.columns == b.columns and a.count() == b.count()


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
