"""Near copies by the similarity of their sets of word shingles, decided exactly.

Candidates are first texts whose SimHash fingerprints differ in at most 2 bits, met by pigeonring keys of
fingerprint pieces (``simhash.hamming_links``); none of these pairs is missed. But the fingerprints of two texts whose
five-word shingles have a Jaccard similarity of 0.8 differ in about 10 of 64 bits, up to some 26. No piece of a
fingerprint is selective at such a distance, so what is further apart also meets elsewhere: ``BANDS`` keys of a text, each a hash of ``ROWS`` min-wise sampled shingles. A pair at 0.8
shares a key with a probability of 1 - (1 - 0.8^5)^20 = 0.9996. Candidates then pass

1. the ratio of the sets' sizes,
2. the pigeonring filter: a chain of consecutive segments whose running sums of differing bits stay within
   their share of the whole budget (no pair within the budget fails it),
3. the full Hamming check (2 and 3 only where both sets have enough shingles for it to be safe), and
4. the Jaccard similarity of the shingle sets themselves.

Pairs of a key are not all tried. Each text that fingerprints didn't bring to another is first tried against the smallest id it meets, and what was
linked is one component. Only where a key still holds several components are texts outside the largest of
them tried against those of other components, in bounded blocks. A key of copies thus costs as much as it has
texts; only texts that share a key but are all unlike each other are tried in pairs.

Defined results: a null or blank text has no shingles and is a copy of any other such text; texts of fewer
than ``words`` words are one shingle; rows with a null id stay and drop nothing; rows that repeat an id are
judged each by its text, and those that repeat the id that stays all stay; an empty table gives an empty
result; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import checkpoint, discard, free_name, join_by_size, release, stored, text_batches, text_or_empty
from .components import connected_components, joined_components
from .simhash import fingerprint, hamming_links, ring_chain, shingle_hashes

BANDS, ROWS = 20, 5
#: Bits that fingerprints of a pair at 0.8 may differ in: 5.6 standard deviations above the mean of 9.7 (one pair in 10^8
#: differs in more). That holds for sets of some size; pairs with a set of fewer than ``SMALL`` shingles go straight on.
FAR, SMALL = 26, 32
SEGMENTS = 8
_SALTS = 8
#: Texts of a key per part of its smallest text's row in the joins that fetch texts.
_PART = 512
_BLOCK = 2048
#: Texts and shingles of a block's side.
_SIDE, _WORDS = 256, 2_000_000
_CHAIN = 3
_DRAWS = np.random.default_rng(42)
_MASKS, _ODDS = _DRAWS.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` signed 64-bit keys of a set of shingle hashes; one key for the empty set."""
    if not len(shingles):
        return np.zeros(1, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        low = np.minimum(low, ((shingles[None, at : at + _BLOCK] ^ _MASKS) * _ODDS).min(axis=1))
    parts = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), i) for i, p in enumerate(parts)], np.uint64).view(np.int64)


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Jaccard similarity of two sorted arrays without repeats; two empty sets are the same."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common) - 1e-9


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """``_id, _fp, _n, _keys``: fingerprint and size of the shingle set, and its band keys."""

    def run(batches):
        for b in text_batches(batches):
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            prints = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints), pa.array([len(s) for s in sets], pa.int64()), keys], ["_id", "_fp", "_n", "_keys"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _fp long, _n long, _keys array<long>")


def _possible(a: str, b: str, least: float) -> Column:
    """Sizes, chain, then the full distance."""
    fit = F.least(f"{a}._n", f"{b}._n") >= F.greatest(f"{a}._n", f"{b}._n") * least
    diff = F.col(f"{a}._fp").bitwiseXOR(F.col(f"{b}._fp"))
    near = ring_chain(diff, SEGMENTS, FAR, longest=_CHAIN) & (F.bit_count(diff) <= FAR)
    return fit & ((F.least(f"{a}._n", f"{b}._n") < SMALL) | near)


def _ring_pairs(made: DataFrame, least: float) -> DataFrame:
    """``a, b, _size`` as ``_verified`` takes them: texts of sizes that fit, whose fingerprints are equal or linked at 2 bits; the smallest id of a fingerprint stands for it."""
    values = checkpoint(made.groupBy("_fp").agg(F.min(F.struct("_id", "_n")).alias("_m"), F.count(F.lit(1)).alias("_size")))
    first = lambda fp, name: values.select(F.col("_fp").alias(fp), F.col("_m").alias(name))
    near = hamming_links(values.select("_fp")).join(first("a", "l"), "a").join(first("b", "m"), "b")
    near = near.select(F.least("l", "m").alias("l"), F.greatest("l", "m").alias("m"), F.lit(1).cast("long").alias("_size"))
    shared = values.where("_size > 1").select("_fp", F.col("_m").alias("l"), "_size")
    same = join_by_size(made.select("_fp", F.struct("_id", "_n").alias("m")), shared, ["_fp"], "_size").where("l._id < m._id")
    fit = F.least("l._n", "m._n") >= F.greatest("l._n", "m._n") * least
    return near.unionByName(same.select("l", "m", "_size")).where(fit).select(F.col("l._id").alias("a"), F.col("m._id").alias("b"), "_size")


def _verified(pairs: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """``pairs(a, b, _size)`` -> the ``a, b`` that are alike. ``_size`` tells how often its ``a`` may come up.

    A text that many pairs name is held in as many parts as its key's size asks for, so no task meets all
    of its pairs.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("_size") / _PART)).cast("long")
    dealt = pairs.select("a", "b", parts.alias("_parts")).withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("_parts")))
    named = dealt.groupBy("a").agg(F.max("_parts").alias("_parts"))
    held = named.join(rows.select(F.col("_id").alias("a"), F.col("_text").alias("_ta")), "a")
    held = held.select("a", "_ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_salt"))
    full = dealt.select("a", "b", "_salt").join(rows.select(F.col("_id").alias("b"), F.col("_text").alias("_tb")), "b").join(held, ["a", "_salt"])
    full = full.select("a", "b", "_ta", "_tb")

    def run(batches):
        name, own = None, None
        for batch in text_batches(batches):
            keep = []
            for a, ta, tb in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if own is None or name != (a, ta):
                    name, own = (a, ta), shingle_set(ta, words)
                keep.append(alike(own, shingle_set(tb, words), least))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = rows.schema["_id"].dataType.simpleString()
    return full.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def _chains(diff: np.ndarray) -> np.ndarray:
    """``ring_chain`` and the full distance for an array of differing bits."""
    d = np.bitwise_count(np.ascontiguousarray(diff)[..., None].view(np.uint8)).astype(np.int64)
    total, fits = np.zeros_like(d), np.ones(d.shape, bool)
    for n in range(_CHAIN):
        total = total + np.roll(d, -n, axis=-1)
        fits &= total <= (n + 1) * FAR // SEGMENTS
    return fits.any(axis=-1) & (d.sum(axis=-1) <= FAR)


def _banded(keys: list[list[int]]) -> np.ndarray:
    """A row of ``BANDS`` keys each; the one key of an empty set stands in every band."""
    return np.array([k if len(k) == BANDS else k * BANDS for k in keys], np.int64).reshape(len(keys), BANDS)


def _first_shared(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The smallest key that each row has in the same band as ``own``; the largest number where there is none."""
    return np.where(keys == own, keys, np.iinfo(np.int64).max).min(axis=1)


def _block_links(split: DataFrame, made: DataFrame, rows: DataFrame, words: int, least: float) -> DataFrame:
    """Links ``a, b`` of components (by their names) that share a key, from blocks of at most about ``_SIDE`` texts a side.

    A pair is tried under the smallest key that it shares, and not where the block has joined it already.
    """
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    of = lambda n: F.pmod(F.xxhash64("m._id"), F.col(n))
    own = split.select("*", F.col("m._id").alias("_id")).join(made.select("_id", "_keys"), "_id").join(rows, "_id")
    cols = ["_key", "_part", "_main", "_id", F.col("m._fp").alias("_fp"), F.col("m._n").alias("_n"), "_keys", "_text"]
    x = own.where("_part <> _main").select(*cols, F.lit(True).alias("_x"), of("_nx").alias("_bx"), upto("_ny").alias("_by"))
    y = own.select(*cols, F.lit(False).alias("_x"), upto("_nx").alias("_bx"), of("_ny").alias("_by"))

    def run(group: pa.Table) -> pa.Table:
        if len(group.column("_x").unique()) < 2:
            return pa.table({"a": group.column("_id").slice(0, 0), "b": group.column("_id").slice(0, 0)})
        key, main = group.column("_key")[0].as_py(), group.column("_main")[0].as_py()
        ids, part, is_x = (group.column(c).to_pylist() for c in ("_id", "_part", "_x"))
        texts, keys = group.column("_text"), _banded(group.column("_keys").to_pylist())
        fp = group.column("_fp").to_numpy().view(np.uint64)
        size = group.column("_n").to_numpy()
        xs, ys = (np.array([i for i, f in enumerate(is_x) if f == side], np.int64) for side in (True, False))
        sets, root, a, b = {}, {p: p for p in part}, [], []

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i].as_py(), words)
            return sets[i]

        def top(p):
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        for i in xs.tolist():
            small, large = np.minimum(size[i], size[ys]), np.maximum(size[i], size[ys])
            fit = ys[(small >= large * least) & ((small < SMALL) | _chains(fp[ys] ^ fp[i]))]
            for j in fit[_first_shared(keys[fit], keys[i]) == key].tolist():
                if (part[j] == main or ids[i] < ids[j]) and top(part[i]) != top(part[j]) and alike(shingles(i), shingles(j), least):
                    root[top(part[i])] = top(part[j])
                    a.append(part[i]), b.append(part[j])
        kind = group.schema.field("_id").type
        return pa.table({"a": pa.array(a, kind), "b": pa.array(b, kind)})

    kind = rows.schema["_id"].dataType.simpleString()
    return x.unionByName(y).groupBy("_key", "_bx", "_by").applyInArrow(run, f"a {kind}, b {kind}")


def near_copy_groups(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, component``: ids that have a near copy, with the smallest id that near copies lead to."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).where("_id IS NOT NULL")
    made = stored(_sketches(rows, words), "sketches")
    keyed = made.select(F.struct("_id", "_fp", "_n").alias("m"), F.explode("_keys").alias("_key")).withColumn("_salt", F.pmod(F.xxhash64("m._id"), F.lit(_SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).alias("_salt")
    keys = keyed.groupBy("_key").agg(F.min("m").alias("l"), F.max("m._id").alias("_last"), F.count(F.lit(1)).alias("_size")).where("l._id < _last")
    met = stored(keyed.join(keys.select("_key", "l", "_size", salts), ["_key", "_salt"]).select("_key", "_salt", "m", "l", "_size"), "met")
    ring = checkpoint(_ring_pairs(made, least))
    release(docs.sparkSession)
    led = met.where("l._id < m._id").where(_possible("l", "m", least))
    first = led.groupBy(F.col("m._id").alias("b")).agg(F.min(F.struct("l._id", "_size")).alias("p")).select("p._id", "b", "p._size").withColumnRenamed("_id", "a")
    first = first.join(ring.select("b"), "b", "left_anti").unionByName(ring)
    links = checkpoint(_verified(first, rows, words, least))
    release(docs.sparkSession)
    parts = connected_components(links)

    found = met.select("_key", "_salt", "m", F.col("m._id").alias("node")).join(parts, "node", "left").withColumn("_part", F.coalesce("component", "node")).drop("node", "component")
    counts = found.groupBy("_key", "_part").agg(F.count(F.lit(1)).alias("_c"), F.sum("m._n").alias("_w"))
    mixed = counts.groupBy("_key").agg(F.max(F.struct("_c", "_part", "_w")).alias("_main"), F.sum("_c").alias("_c"), F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    blocks = lambda n, w: F.ceil(F.greatest(n / _SIDE, w / _WORDS, F.lit(1))).cast("long")
    outside = blocks(F.col("_c") - F.col("_main._c"), F.col("_w") - F.col("_main._w")).alias("_nx")
    mixed = mixed.select("_key", F.col("_main._part").alias("_main"), outside, blocks(F.col("_c"), F.col("_w")).alias("_ny"), salts)
    split = stored(found.join(mixed, ["_key", "_salt"]).select("_key", "m", "_part", "_main", "_nx", "_ny"), "split")
    release(docs.sparkSession)
    if not split.isEmpty():
        between = checkpoint(_block_links(split, made, rows, words, least).distinct())
        release(docs.sparkSession)
        parts = joined_components(parts, between)
    discard(made, met, split)
    return parts.select(F.col("node").alias("_id"), "component")


def drop_near_copies(docs: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the rows of the smallest id of each group of near copies; every row is judged by its own text."""
    own = free_name(docs, "_near_row")
    rows = stored(docs.withColumn(own, F.monotonically_increasing_id()), "rows")
    named = rows.where(F.col(id_col).isNotNull())
    groups = near_copy_groups(named, words, least, own, text_col).join(named.select(F.col(own).alias("_id"), F.col(id_col).alias("_name")), "_id")
    groups = stored(groups, "groups")
    firsts = stored(groups.groupBy("component").agg(F.min("_name").alias("_least"), F.count(F.lit(1)).alias("_n")), "firsts")
    losers = join_by_size(groups, firsts, ["component"], "_n").where("_name > _least").select(F.col("_id").alias(own))
    return rows.join(losers, own, "left_anti").select(*docs.columns)
