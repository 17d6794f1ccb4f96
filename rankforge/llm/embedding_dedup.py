"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, components.

Vectors are compared within their label. Equal vectors are first one class with a multiplicity, so copies
never meet each other. Each table signs a class with ``bits`` hyperplanes; classes with equal signs in
some table are compared by the cosine of their whole vectors in double precision. The number of tables
follows from the bits so that a pair at the threshold itself is missed with a probability of at most
``miss``; pairs above it are missed less often still. A pair that meets in several tables counts in the
first of them alone, which both sides' signs tell.

A bucket of more than ``block`` classes is cut into blocks by a hash, and each pair of blocks is a group
of its own: no task holds more than two blocks, and products are matrix products. What leaves a
group is a row per class with its number of links there and the smallest class it is connected to
there, never the pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows with a null
label and rows with a null id link with nothing, and nothing with them (a null id is passed through, with null as
component); vectors of other lengths share no link; rows that repeat an id are vectors of their own; a vector
is scaled by its largest component before its length is taken, so neither tiny nor huge ones are lost; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import checkpoint, join_by_size, join_hot, stored
from .components import connected_components

BLOCK = 512


def tables_needed(threshold: float, bits: int, miss: float) -> int:
    """Tables so that a pair at ``threshold`` is missed by all with a probability of at most ``miss``."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log(1 - same)))


def _planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, n]).standard_normal((dim, n))


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _signs(vectors: np.ndarray, tables: int, bits: int, seed: int) -> np.ndarray:
    made = (vectors @ _planes(vectors.shape[1], tables * bits, seed) >= 0).reshape(len(vectors), tables, bits)
    return made @ (np.int32(1) << np.arange(bits, dtype=np.int32))  # at most 30 bits


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` is connected to by the edges (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def near_in_group(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links inside one pair of blocks: ``_class, _near`` (vectors linked here) and ``_root``."""
    pdf = pdf.sort_values("_class", ignore_index=True)
    table, first, second = int(pdf["_table"].iloc[0]), pdf["_first"].iloc[0], pdf["_second"].iloc[0]
    x = _unit(np.stack(pdf["_vector"].to_numpy()).astype(np.float64))
    codes, block = np.stack(pdf["_codes"].to_numpy()), pdf["_block"].to_numpy()
    weight, n = pdf["_count"].to_numpy(np.int64), len(pdf)
    near, ii, jj = np.zeros(n, np.int64), [], []
    for at in range(0, n, BLOCK):
        i, j = np.nonzero(x[at : at + BLOCK] @ x.T >= threshold)
        i += at
        keep = i < j
        if first != second:
            keep &= block[i] != block[j]
        i, j = i[keep], j[keep]
        if table:
            fresh = ~(codes[i, :table] == codes[j, :table]).any(axis=1)
            i, j = i[fresh], j[fresh]
        near += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
        ii.append(i)
        jj.append(j)
    root = _roots(n, np.concatenate(ii), np.concatenate(jj))
    made = pd.DataFrame({"_class": pdf["_class"], "_near": near, "_root": pdf["_class"].to_numpy()[root]})
    return made[near > 0]


def embedding_groups(
    vectors: DataFrame, threshold: float = 0.98, miss: float = 0.002, bits: int | None = None, block: int = BLOCK, seed: int = 7,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """A row per input row: ``id_col, n_links, component_id, kept``.

    ``bits`` follows from the number of vectors unless it is given: a bucket then holds about 32 unrelated ones.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"  # products are in doubles either way
    plain = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast(kind).alias("_vector"), F.col(label_col).alias("_label"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.coalesce(finite & F.exists("_vector", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one number, so they are made one key.
    vector = F.when(usable, F.transform("_vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))).cast(kind)
    rows = plain.select("_id", "_label", vector.alias("_vector"))
    key = [F.xxhash64("_label", "_vector").alias("_h1"), F.xxhash64(F.lit("second"), "_label", "_vector").alias("_h2")]
    classes = rows.where(F.col("_vector").isNotNull()).groupBy("_label", "_vector").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_count"))
    classes = checkpoint(classes.select("*", *key, F.monotonically_increasing_id().alias("_class")))  # ids may repeat, so a class gets a number
    names = stored(rows.select("_id", *[F.when(F.col("_vector").isNotNull(), k).alias(n) for k, n in zip(key, ("_h1", "_h2"))]), "names")
    if bits is None:
        largest = classes.groupBy("_label").count().agg(F.max("count")).first()[0] or 0
        bits = min(30, max(6, math.ceil(math.log2(max(1, largest) / 32)))) if largest else 6
    tables = tables_needed(threshold, bits, miss)

    def sign(frames):
        for pdf in frames:
            codes = [None] * len(pdf)
            size = pdf["_vector"].map(len)
            for dim in size.unique():
                at = np.flatnonzero(size == dim)
                for k, row in zip(at, _signs(_unit(np.stack(pdf["_vector"].iloc[at].to_numpy()).astype(np.float64)), tables, bits, seed)):
                    codes[k] = row
            yield pdf.assign(_codes=codes)

    signed = classes.select("_class", "_label", "_count", "_vector").mapInPandas(sign, f"_class long, _label {rows.schema['_label'].dataType.simpleString()}, _count long, _vector {kind}, _codes array<int>")
    signed = checkpoint(signed)
    bucket = ["_label", "_dim", "_table", "_code"]
    coded = signed.withColumn("_dim", F.size("_vector")).select("*", F.posexplode("_codes").alias("_table", "_code"))
    met = checkpoint(coded.select(*bucket).groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    own = F.pmod(F.xxhash64("_class"), blocks).cast("int")
    dealt = coded.join(met, bucket).withColumn("_blocks", blocks).withColumn("_block", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.select(*bucket, "_class", "_count", "_vector", "_codes", "_block", F.least("_block", "_other").alias("_first"), F.greatest("_block", "_other").alias("_second"))
    found = dealt.groupBy(*bucket, "_first", "_second").applyInPandas(lambda pdf: near_in_group(pdf, threshold), "_class long, _near long, _root long")
    found = checkpoint(found)
    parts = connected_components(found.where("_root <> _class").select(F.col("_class").alias("a"), F.col("_root").alias("b")))
    linked = found.groupBy("_class").agg(F.sum("_near").alias("_near"))
    named = classes.select("_h1", "_h2", "_class", "_least", "_count").join(linked, "_class", "left").join(parts.withColumnRenamed("node", "_class"), "_class", "left")
    named = checkpoint(named.select("_h1", "_h2", "_least", "_count", (F.coalesce("_near", F.lit(0)) + F.col("_count") - 1).alias("_links"), F.coalesce("component", "_class").alias("_part")))
    least = named.groupBy("_part").agg(F.min("_least").alias("_component"))
    named = stored(join_hot(named, least, "_part").select("_h1", "_h2", "_count", "_links", "_component"), "named")
    # The two hashes of label and vector (128 bits) stand for them here; classes were told apart by the values themselves.
    linked_rows = join_by_size(names.where("_h1 IS NOT NULL"), named, ["_h1", "_h2"], "_count").select("_id", "_links", "_component")
    out = linked_rows.unionByName(names.where("_h1 IS NULL").select("_id", F.lit(0).cast("long").alias("_links"), F.col("_id").alias("_component")))
    return out.select(F.col("_id").alias(id_col), F.col("_links").alias("n_links"), F.col("_component").alias("component_id"), F.col("_id").eqNullSafe(F.col("_component")).alias("kept"))
