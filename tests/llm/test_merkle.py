"""The manifest against a tree built whole in plain Python, and its SQL."""

import hashlib
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"
h = lambda s: hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """All levels up to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        out.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        at //= 16
    return out


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[s] = (own, tree([leaf(r) for r in own]))
    top = tree([subs[s][1][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        own, levels = subs[s]
        for i, r in enumerate(own):
            steps = path(levels, i) + path(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            node = leaf((*r[:4], r[4].encode().lower().decode())) if hit else leaf(r)
            for before, after in steps:
                node = h(before + node + after)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], h("".join(b + a for b, a in steps)), node, node == top[-1][0]))
    return out


def digest(spark, rows):
    return [tuple(r) for r in merkle.manifest_digest(spark.createDataFrame(rows, SCHEMA)).collect()]


key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))


def test_sources_of_all_sizes_and_nulls(spark):
    rows = [(i, f"s{i % 19}", "en", i, f"Text {i} É") for i in range(700)]
    rows += [(10_000 + i, None, None, None, None if i % 2 else "") for i in range(40)]
    rows += [(20_000, "alone", "ca", 3, "Abc"), (None, "s1", None, 1, "X"), (None, "s1", None, 1, "X"), (7, "s7", "en", 7, "Text 7 É"), (7, "s7", "en", 7, "again"), (21_000, "é", "x", 1, "A" * 300_000)]
    assert sorted(digest(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_blocks_above_blocks(spark):
    rows = [(i, "hot", "en", i, f"T{i}") for i in range(9000)] + [(100_000 + i, "b", None, None, f"U{i}") for i in range(4097)]
    assert sorted(digest(spark, rows)) == sorted(brute(rows))


def test_one_row_none_and_clashing_names(spark):
    one = [(5, "a", "b", 1, "Some Text")]
    assert digest(spark, one) == brute(one)
    assert digest(spark, []) == []
    rows = [(i, "a", "b", 1, "Some Text") for i in range(40)]
    names = ["_group", "_node", "_pos", "_k0", "_id", "_above", "_root", "_block", "path", "leaf", "position", "_tampered", "_part", "_n"]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(n) for n in names])
    assert sorted(tuple(r) for r in merkle.manifest_digest(df).collect()) == sorted(brute(rows))


def test_manifest_paths_lead_to_the_root(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"T{i}") for i in range(100)]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA))
    assert isinstance(made.schema["path"].dataType, T.ArrayType)
    assert made.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert sorted((r.source, r.position) for r in made.collect()) == sorted((f"s{i % 3}", i // 3) for i in range(100))


def test_traversal_of_every_block_size():
    for n in [1, 2, 15, 16, 17, 255, 256, 257, 271, 272, 273, 511, 513, 4095, 4096]:
        leaves = [h(str(i)) for i in range(n)]
        levels = tree(leaves)
        walk = merkle.Traversal([x.encode() for x in leaves], merkle.block_levels(n, 0))
        got = [[(b.decode(), a.decode()) for b, a in p] for p in walk]
        assert walk.root.decode() == levels[-1][0] and got == [path(levels, i) for i in range(n)]


def test_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    made = queries.op13_merkle_manifest(spark, folder)
    want = db.execute(queries.oracle_sql()["op13_merkle_manifest"])
    assert [c[0] for c in want.description] == made.columns
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in made.collect())
