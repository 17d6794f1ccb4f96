"""Byte-pair encoding pieces shared by the token counter and the packer.

``units`` cuts a text where a byte-level pre-tokenizer of the GPT-2 kind always cuts, whatever stands
around: before a white-space character that has no white space beside it. Units repeat, so a bounded
cache per Python worker holds what was worked out for them.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

#: White space in front of a word belongs to it; of a longer run of white space all but the last is a unit of its own.
_UNITS = re.compile(r"\s?\S+|\s+(?!\S)")
#: Separators that Python's ``\s`` has and Unicode's White_Space lacks.
_ODD = re.compile("[\x1c-\x1f]")
#: Fixed value: the pre-tokenizer pattern of byte-level BPE with ``use_regex``.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_ENTRIES = 500_000
#: Longer units hardly come again, so they are worked out each time.
CACHE_CHARS = 64


def units(text: str) -> list[str]:
    """Independent pieces of ``text``, in order; joined they give the text."""
    if _ODD.search(text):
        return [text]
    return _UNITS.findall(text)


class _NotHere(Exception):
    """A blank beside other white space: the text can't simply be split at blanks."""


class Known(dict):
    """Values of units, worked out by ``make`` when asked for and kept until the dictionary is full."""

    def __init__(self, make, before: str = "", entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.before, self.entries = make, before, entries

    def __missing__(self, key):
        if self.before and (not key or key[0].isspace() or key[-1].isspace()):
            raise _NotHere
        value = self.make(self.before + key)
        if len(self) < self.entries and len(key) <= CACHE_CHARS:
            self[key] = value
        return value


class UnitValues:
    """The values of a text's units, in order, most of them by one look-up for each blank-separated word."""

    def __init__(self, make):
        self.any, self.spaced = Known(make), Known(make, " ")

    def of(self, text: str) -> list:
        head, *rest = text.split(" ")
        if head and not head[0].isspace() and not head[-1].isspace():
            try:
                return [self.any[head], *map(self.spaced.__getitem__, rest)]
            except _NotHere:
                pass
        return list(map(self.any.__getitem__, units(text)))


@lru_cache(maxsize=4)
def spec(path: str) -> dict:
    """The vocabulary file as ranks over byte-level symbols; only byte-level BPE without normaliser is taken."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, pre = data["model"], data.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or data.get("normalizer") or model.get("dropout"):
        raise ValueError(f"{path}: a byte-level BPE without normaliser, prefix space and dropout is needed")
    ranks = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    return {"ranks": ranks, "special": [x["content"] for x in data.get("added_tokens", [])], "vocab": model["vocab"], "ignore_merges": bool(model.get("ignore_merges"))}


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 keeps itself, the rest follows from U+0100."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in keep else next(rest)) for b in range(256)]


def count_symbols(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after byte-pair merging: the initial number less one for each merge.

    A heap holds adjacent pairs by (rank, place); a linked list over the places holds what is still
    alive. A popped pair counts only if both of its symbols are as they were when it was pushed.
    """
    n = len(symbols)
    if n < 2:
        return n
    alive, prev, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if alive[i] != a or j >= n or alive[j] != b:
            continue
        merges += 1
        alive[i], alive[j] = a + b, None
        after[i] = k = after[j]
        if k < n:
            prev[k] = i
            if (r := ranks.get((alive[i], alive[k]))) is not None:
                heapq.heappush(heap, (r, i, alive[i], alive[k]))
        if (h := prev[i]) >= 0 and (r := ranks.get((alive[h], alive[i]))) is not None:
            heapq.heappush(heap, (r, h, alive[h], alive[i]))
    return n - merges
