"""A Bloom filter of bounded size over 64-bit keys, built by Spark in segments and sent to every worker."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SEGMENTS = 64
_PROBES = 3


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of each key inside its segment of ``bits`` bits; the segment is in the key's lowest six."""
    x = (keys >> np.uint64(6)) * np.uint64(0x9E3779B97F4A7C15)
    step = (x >> np.uint64(32)) | np.uint64(1)
    return [((x + np.uint64(i) * step) ^ (x >> np.uint64(29))) % np.uint64(bits) for i in range(_PROBES)]


class Bloom:
    def __init__(self, segments: dict[int, bytes], bits: int):
        empty = bytes(bits // 8)
        self.bits = bits
        self.bitmap = np.frombuffer(b"".join(segments.get(s, empty) for s in range(_SEGMENTS)), np.uint8)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """No key that was put in is ever missed; some others may be held too."""
        base = (keys & np.uint64(_SEGMENTS - 1)) * np.uint64(self.bits)
        out = np.ones(len(keys), bool)
        for p in _places(keys, self.bits):
            at = base + p
            out &= (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def _bits(n: int) -> int:
    """Bits of a segment: 8 to 16 for each of its keys, a power of two."""
    return 1 << max(9, int(8 * max(1, n) / _SEGMENTS - 1).bit_length())


def bloom_bytes(n: int) -> int:
    """Size of the filter of ``n`` keys, which the caller holds against its bound."""
    return _bits(n) * _SEGMENTS // 8


def build_bloom(keys: DataFrame, n: int) -> tuple[dict[int, bytes], int]:
    """Of ``keys(key long)``, ``n`` in number, for ``Bloom(*...)``; ``bloom_bytes(n)`` long."""
    bits = _bits(n)

    def segment(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["key"].to_numpy(np.int64).view(np.uint64)
        marks = np.zeros(bits, bool)
        for p in _places(own, bits):
            marks[p] = True
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "bitmap": [np.packbits(marks, bitorder="little").tobytes()]})

    made = keys.select("key", F.col("key").bitwiseAND(F.lit(_SEGMENTS - 1)).cast("int").alias("segment")).groupBy("segment").applyInPandas(segment, "segment int, bitmap binary")
    return {r["segment"]: r["bitmap"] for r in made.collect()}, bits  # bloom_bytes(n), below the caller's bound
