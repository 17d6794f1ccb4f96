"""Packing token sequences: minimum bin slack over the lengths that remain after full windows.

Every document gives full windows of ``capacity`` ids and one remaining piece. Remaining pieces wait in
a bounded pool; a window starts with the longest piece of the pool, and a subset-sum dynamic programme
over the multiset of the other lengths (one big integer is the bitset of sums that can be reached) picks
what fills it closest to capacity, with counts found by tracing back. The slack that is left, if any, is
closed by cutting one more piece. At the end of a task what remains is laid out in runs whose lengths
are powers of two, which need no padding. So no sequence needs any.

Everything happens in the task that reads the texts: no exchange, no state beyond the pool. Sequence ids
carry the task's partition in their upper bits, so a repeated task gives the same ids.

Defined results: a null text counts as empty, and an empty text is the end mark alone; a null id is
passed through; repeated rows are packed again; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import text_batches, text_or_empty
from .bpe import PRE_TOKEN, byte_symbols, spec

#: Pieces that wait at most; half of them are packed when it is full.
POOL = 8192


#: A run of white space from which the second library's pattern would outgrow its stack.
_LONG_SPACE = re.compile(r"\s{50000}")


def _core(path: str):
    """The same vocabulary for tiktoken, which is several times faster; None if the file's ids don't rise with
    its merges (ranks and ids must be the same for that) or the library is missing."""
    try:
        import tiktoken

        made = spec(path)
    except (ImportError, ValueError):
        return None
    vocab, order = made["vocab"], [made["vocab"].get(a + b, -1) for a, b in made["ranks"]]
    if made["ignore_merges"] or order != sorted(order) or -1 in order or max(vocab[x] for x in byte_symbols()) >= order[0]:
        return None
    back = {c: b for b, c in enumerate(byte_symbols())}
    ranks = {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in made["special"]}
    return tiktoken.Encoding("packing", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


class Ids:
    """Whole texts to little-endian unsigned 32-bit ids, as bytes.

    Texts that hold an added token or an endless run of white space go to the tokenizers library, the others
    to tiktoken with the ranks of the same file (``fast=False``: all to the library). The ids are the same.
    """

    def __init__(self, path: str, fast: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.core = _core(path) if fast else None

    def _plain(self, text: str) -> bool:
        return not any(s in text for s in self.special) and (len(text) < 50_000 or not _LONG_SPACE.search(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.core is None:
            rest = list(range(len(texts)))
        else:
            rest = [i for i, t in enumerate(texts) if not self._plain(t)]
        out: list[bytes | None] = [None] * len(texts)
        for i, e in zip(rest, self.library.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = array("I", e.ids).tobytes()
        return [array("I", self.core.encode_ordinary(t)).tobytes() if ids is None else ids for t, ids in zip(texts, out)]


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One per Python worker."""
    return Ids(path)


def best_fill(counts: dict[int, int], room: int, rising: list[int] | None = None) -> list[int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is closest to ``room`` from below.

    ``rising`` may hold the lengths in order.

    Lengths are taken from long to short until ``room`` itself can be reached. ``reached[k]`` is the
    bitset of sums after the first k lengths; tracing back takes as few of the later lengths as it can.
    """
    mask, bits = (1 << (room + 1)) - 1, 1
    reached, used = [bits], []
    rising = sorted(counts) if rising is None else rising
    for k in range(bisect_right(rising, room) - 1, -1, -1):
        length = rising[k]
        before = bits
        left, step = counts[length], 1  # 1, 2, 4, ... copies reach every number of them
        while left and step * length <= room:
            take = min(step, left)
            bits |= (bits << (take * length)) & mask
            left -= take
            step *= 2
        if bits != before:
            used.append(length)
            reached.append(bits)
            if bits >> room & 1:
                break
    total, picked = bits.bit_length() - 1, []
    for k in range(len(used), 0, -1):
        while not reached[k - 1] >> total & 1:
            picked.append(used[k - 1])
            total -= used[k - 1]
    return picked


class Packer:
    """Packs the documents of one task; ``emit`` gets (row, start, ids as bytes, sequence, offset)."""

    def __init__(self, capacity: int, base: int, emit, pool: int = POOL):
        self.capacity, self.next, self.emit, self.limit = capacity, base, emit, pool
        self.pool: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.rising: list[int] = []  # the lengths in the pool
        self.waiting = 0

    def add(self, row, ids: bytes) -> None:
        n, start, c = len(ids) // 4, 0, self.capacity
        while n - start >= c:
            self.emit(row, start, ids[4 * start : 4 * (start + c)], self.next, 0)
            self.next += 1
            start += c
        if n > start:
            self._wait((row, start, ids[4 * start :]))
        if self.waiting >= self.limit:
            while self.waiting > self.limit // 2:
                self._window()

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if n not in self.pool:
            self.pool[n], self.counts[n] = [], 0
            insort(self.rising, n)
        self.pool[n].append(piece)
        self.counts[n] += 1
        self.waiting += 1

    def _take(self, length: int) -> tuple:
        pieces = self.pool[length]
        piece = pieces.pop()
        self.counts[length] -= 1
        if not pieces:
            del self.pool[length], self.counts[length], self.rising[bisect_right(self.rising, length) - 1]
        self.waiting -= 1
        return piece

    def _window(self) -> None:
        """One full window: longest piece, best fill, and a cut where slack is left."""
        chosen = [self._take(self.rising[-1])]
        room = self.capacity - len(chosen[0][2]) // 4
        chosen += [self._take(n) for n in best_fill(self.counts, room, self.rising)]
        slack = self.capacity - sum(len(p[2]) // 4 for p in chosen)
        while slack:
            row, start, ids = self._take(self.rising[-1])
            take = min(slack, len(ids) // 4)
            chosen.append((row, start, ids[: 4 * take]))
            if take < len(ids) // 4:
                self._wait((row, start + take, ids[4 * take :]))
            slack -= take
        self._lay(chosen)

    def _lay(self, pieces: list[tuple]) -> None:
        at = 0
        for row, start, ids in pieces:
            self.emit(row, start, ids, self.next, at)
            at += len(ids) // 4
        self.next += 1

    def finish(self) -> None:
        """Full windows while there are ids enough, then runs of 1024, 512, ... as the rest's binary digits say."""
        rest = sum(k * n for k, n in self.counts.items())
        while rest >= self.capacity:
            self._window()
            rest -= self.capacity
        size = 1 << (rest.bit_length() - 1) if rest else 0
        while rest:
            if rest < size:
                size >>= 1
                continue
            chosen, need = [], size
            while need:
                row, start, ids = self._take(self.rising[-1])
                take = min(need, len(ids) // 4)
                chosen.append((row, start, ids[: 4 * take]))
                if take < len(ids) // 4:
                    self._wait((row, start + take, ids[4 * take :]))
                need -= take
            self._lay(chosen)
            rest -= size


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = rows.schema["_id"].dataType
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches):
        out: list[tuple] = []
        emit = lambda row, start, ids, seq, at: out.append((row[0], start, len(ids) // 4, zlib.crc32(ids), row[1], seq, at))
        packer, encode, id_type = Packer(capacity, TaskContext.get().partitionId() << 36, emit), ids_of(tokenizer_path).encode, None

        def batch():
            cols = list(zip(*out)) or [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:])], names)

        for b in text_batches(batches):
            id_type = b.column(0).type
            for key, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist())):
                packer.add((key, len(ids) // 4 + 1), ids + end)
            if out:
                yield batch()
        packer.finish()
        if out:
            yield batch()

    made = rows.mapInArrow(run, f"_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:]))
    return made.withColumnRenamed("_id", id_col)
