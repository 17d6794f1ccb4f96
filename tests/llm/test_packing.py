"""Packing at its production size: the pool fills, every id lies in one piece, sequences are full; and both id paths agree."""

import random
from collections import defaultdict

import pytest

P = pytest.importorskip("public_tokenizers")

from rankforge.llm.packing import POOL, Ids, Packer  # noqa: E402


def test_full_size_pool():
    draw, got = random.Random(5), []
    packer = Packer(2048, 7 << 36, lambda row, start, ids, seq, at: got.append((row, start, len(ids) // 4, seq, at)))
    lengths = [draw.choice((1, draw.randint(1, 300), draw.randint(1, 6000))) for _ in range(3 * POOL)]
    most = 0
    for i, n in enumerate(lengths):
        packer.add(i, bytes(4 * n))
        most = max(most, packer.waiting)
    packer.finish()
    assert POOL // 2 < most <= POOL and not packer.pool and not packer.counts and not packer.rising
    pieces, sequences = defaultdict(list), defaultdict(list)
    for row, start, n, seq, at in got:
        pieces[row].append((start, n))
        sequences[seq].append((at, n))
    for i, n in enumerate(lengths):
        own = sorted(pieces[i])
        assert own[0][0] == 0 and sum(x[1] for x in own) == n and all(a + k == b for (a, k), (b, _) in zip(own, own[1:]))
    short = 0
    for own in sequences.values():
        own.sort()
        total = sum(n for _, n in own)
        assert own[0][0] == 0 and all(a + k == b for (a, k), (b, _) in zip(own, own[1:])) and total & (total - 1) == 0 and total <= 2048
        short += total < 2048
    assert short <= 11 and len(got) - len(lengths) < 2 * len(sequences)


def test_both_ways_to_ids_agree():
    path = str(P.path("byte_bpe_50k.json"))
    odd = ["\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", " ", "　", "﻿", "é", "ß", "ж", "字", "😀", "١", "²", "'", "’", "\0"]
    texts = [f"a{c}b {c} 7{c}  {c}{c}x{c} \n" for c in odd]
    texts += ["", " ", "  ", "\n\n", "we're it'll I'd 'twas", "<|endoftext|>", "x<|endoftext|> y", " " * 1_200_000 + "x", "a" * 60_000, "ab 12 !?\n" * 20_000]
    fast, plain = Ids(path), Ids(path, fast=False)
    assert fast.core is not None and plain.core is None
    assert fast.encode(texts) == plain.encode(texts)
