"""SimHash near-duplicates with pigeonring candidates.

Fingerprints are compared as distinct values. For a distance of at most 2 a fingerprint's four 16-bit
segments form a ring; by the pigeonring principle some segment starts a chain whose running sums of
differences stay within l * 2/4 after l segments: 0, then at most 1, then at most 1. So the first
segment is equal, and the next two differ in at most one bit between them; one of those two is equal
as well. Six keys of two equal segments therefore meet every pair, and the chain test on what they bring
together leaves few pairs for the full Hamming check.

A key met by many fingerprints would give all pairs of a dense group. Fingerprints on such a key go
another exact way, linear in their number: two values differ in at most 2 bits if and only if some value
is within 1 bit of both, so each of them names the 65 values within 1 bit of itself, and what names the
same value is linked in a star (at most 65 can).

Defined results: a null or blank text has fingerprint zero and is linked like any other; a null id takes
part in no component minimum except where nothing else is there; repeated rows give a row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import checkpoint, join_by_size, join_hot, text_batches, text_or_empty
from .components import connected_components

#: A key that more fingerprints meet than this goes the star's way.
DENSE = 48
_SEED = 42
_BLOCK = 1 << 15


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words (A-Z lower-cased, joined by one blank), repeats included."""
    parts = text.encode().lower().split()
    if not parts:
        return []
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return [digest(b" ".join(parts), _SEED)]
    joined, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    return [digest(joined[a:b], _SEED) for a, b in zip(starts, ends[words - 1 :])]


def fingerprint(hashes: list[int] | np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 for none."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        block = np.array(hashes[at : at + _BLOCK], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _fp``: the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))

    def run(batches):
        for b in text_batches(batches):
            made = [fingerprint(shingle_hashes(t, words)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["_id", "_fp"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _ring_keys(fp: Column) -> Column:
    """Two equal segments: a chain's first with its second or its third. Bits above 32 say which two."""
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3)]
    keys = [F.lit(k << 32) + F.shiftleft(_segment(fp, i).cast("long"), 16) + _segment(fp, j) for k, (i, j) in enumerate(pairs)]
    return F.array(*keys)


def ring_chain(diff: Column, segments: int, far: int, longest: int) -> Column:
    """Some segment starts a chain around the ring whose first ``longest`` running sums stay within their share.

    Of ``far`` differing bits, l segments may hold l * far / segments; no pair within ``far`` fails.
    """
    width = 64 // segments
    d = [F.bit_count(F.shiftrightunsigned(diff, width * i).bitwiseAND(F.lit((1 << width) - 1))) for i in range(segments)]
    found = F.lit(False)
    for start in range(segments):
        total, fits = F.lit(0), F.lit(True)
        for n in range(1, longest + 1):
            total = total + d[(start + n - 1) % segments]
            fits = fits & (total <= n * far // segments)
        found = found | fits
    return found


def _flips(fp: Column) -> Column:
    """The value itself and the 64 that differ from it in one bit."""
    return F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int")))))


def hamming_links(values: DataFrame, dense: int = DENSE) -> DataFrame:
    """Distinct ``_fp`` -> links ``a, b`` that connect exactly what pairs at 2 or fewer bits connect."""
    keyed = values.select("_fp", F.explode(_ring_keys(F.col("_fp"))).alias("_key"))
    met = checkpoint(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    few = keyed.join(met.where(F.col("_n") <= dense).select("_key"), "_key")
    groups = few.groupBy("_key").agg(F.sort_array(F.collect_list("_fp")).alias("_group"))  # at most ``dense`` long
    near = lambda a: F.filter("_group", lambda b: (a < b) & ring_chain(a.bitwiseXOR(b), 4, 2, 3) & (F.bit_count(a.bitwiseXOR(b)) <= 2))
    pairs = groups.select(F.explode(F.flatten(F.transform("_group", lambda a: F.transform(near(a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("_p"))
    crowded = keyed.join(met.where(F.col("_n") > dense).select("_key"), "_key").select("_fp").distinct()
    stars = crowded.select("_fp", F.explode(_flips(F.col("_fp"))).alias("_mid"))
    hubs = stars.groupBy("_mid").agg(F.min("_fp").alias("a"), F.collect_list("_fp").alias("_all"))  # at most 65 long
    spokes = hubs.where(F.size("_all") > 1).select("a", F.explode("_all").alias("b")).where("a <> b")
    return pairs.select("_p.a", "_p.b").union(spokes).distinct()


def simhash_groups(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``id_col, fingerprint`` (16 hex digits), ``component_id``."""
    prints = checkpoint(fingerprints(docs, words, id_col, text_col))
    values = checkpoint(prints.groupBy("_fp").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")))
    # A value's name in the graph is the value; its component is the smallest id over the component's values.
    parts = connected_components(hamming_links(values.select("_fp")))
    named = values.join(parts.select(F.col("node").alias("_fp"), "component"), "_fp", "left").withColumn("component", F.coalesce("component", "_fp"))
    named = checkpoint(named)
    first = named.groupBy("component").agg(F.min("_first").alias("component_id"))
    of = checkpoint(join_hot(named, first, "component").select("_fp", "_n", "component_id"))
    return join_by_size(prints, of, ["_fp"], "_n").select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"
    )
