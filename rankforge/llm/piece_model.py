"""A SentencePiece BPE model read from its file: offset-preserving normalisation, merging and decoding.

``Normaliser`` takes, at each place, the longest prefix that the compiled character map knows (a double-array
trie over UTF-8 bytes, and a table of replacements) and notes for every byte it writes where it came from.
``PieceModel`` merges the normalised characters, best score first and leftmost among equals, and projects each
piece through these notes to bytes of the original text. Spans of a text's pieces are gapless and cover it
(but for what normalisation drops at its ends).
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: The mark that stands for a blank, and what undecodable bytes become.
MARK, BROKEN = "▁", "�"
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
#: Up to so many symbols are merged by scanning.
SHORT = 48
_NONE = float("-inf")


class CharacterMap:
    """The compiled character map: 4 bytes of the trie's size, the trie's units, replacements that end at NUL."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist()
        self.table = blob[4 + size :]

    def __bool__(self) -> bool:
        return bool(self.units)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``data[at:]`` and its replacement."""
        units, found = self.units, None
        offset = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node = offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (unit := units[node]) & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found and (found[0], self.table[found[1] : self.table.index(b"\0", found[1])])


class Normaliser:
    """``normalise(text)``: the normalised text as UTF-8, and for each of its bytes (and its end) the byte of the original it starts from."""

    def __init__(self, spec, user: list[str]):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.mark = MARK.encode() if spec.escape_whitespaces else b" "
        self.user = re.compile(b"|".join(re.escape(u.encode()) for u in sorted(user, key=len, reverse=True))) if user else None

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        if self.user and (m := self.user.match(data, at)):
            return m.end() - at, m.group()
        if self.map and (hit := self.map.longest(data, at)):
            return hit
        first = data[at]
        n = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        return n, data[at : at + n]

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        data, at = text.encode(), 0
        out, source = bytearray(), []
        if self.squeeze:
            while at < len(data) and (p := self._prefix(data, at))[1] == b" ":
                at += p[0]
        if at >= len(data):
            return b"", [0]
        if self.dummy:
            out += self.mark
            source += [at] * len(self.mark)
        blank = self.squeeze
        while at < len(data):
            n, made = self._prefix(data, at)
            if blank:
                made = made.lstrip(b" ")
            if made:
                escaped = made.replace(b" ", self.mark)
                out += escaped
                source += [at] * len(escaped)
                blank = made.endswith(b" ")
            at += n
            if not self.squeeze:
                blank = False
        if self.squeeze:
            while out.endswith(self.mark):
                del out[-len(self.mark) :]
                at = source[len(out)]
                del source[len(out) :]
        source.append(at)
        return bytes(out), source


@dataclass(slots=True)
class Unit:
    """What a part of a text gives, wherever it stands: its ids and how many bytes of the text each stands for, as packed 32-bit integers,
    their number, the bytes before the first, and the decoded text. Spans have no gaps, so their lengths are enough."""

    ids: bytes
    lengths: bytes
    count: int
    lead: int
    decoded: str


def _packed(values) -> bytes:
    return struct.pack(f"<{len(values)}i", *values)


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self._read(proto)

    @classmethod
    def from_proto(cls, proto) -> PieceModel:
        model = cls.__new__(cls)
        model._read(proto)
        return model

    def _read(self, proto) -> None:
        trainer = proto.trainer_spec
        if trainer.model_type != 2 or trainer.treat_whitespace_as_suffix or any(p.type == UNUSED for p in proto.pieces):
            raise ValueError("a BPE model without unused pieces, blanks in front of words, is needed")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.scores = {p.piece: p.score for p in proto.pieces if p.type in (NORMAL, USER)}
        self.index = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER)}
        self.user = [p.piece for p in proto.pieces if p.type == USER]
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = self.kinds.index(UNKNOWN)
        self.odd = {i for i, k in enumerate(self.kinds) if k in (BYTE, CONTROL, UNKNOWN)}
        self.unknown_text = trainer.unk_surface
        self.end = self.pieces.index(trainer.eos_piece) if trainer.eos_piece in self.pieces else -1
        self.normaliser = Normaliser(proto.normalizer_spec, self.user)
        self.fallback = trainer.byte_fallback and len(self.byte_ids) == 256
        self.strips = proto.normalizer_spec.add_dummy_prefix or proto.normalizer_spec.remove_extra_whitespaces
        n = self.normaliser
        #: No piece goes on past a blank, and each character stands for itself: parts that start at blanks are independent.
        self.apart = not (n.map or n.squeeze or self.user) and n.mark != b" " and not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.index)
        self.parts = _parts(self.index) if self.apart else None
        self._first, self._later = _Known(lambda s: self._unit(s, True)), _Known(lambda s: self._unit(s, False))

    def merge(self, symbols: list[str]) -> list[str]:
        """Symbols after merging; the pair whose union has the best score goes first, the leftmost of equals; user-defined symbols stay as they are."""
        return self._merge_short(symbols) if len(symbols) <= SHORT and not self.user else self._merge_long(symbols)

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """By a scan for the best of a few pairs, which beats a heap there."""
        score = self.scores.get
        parts, pairs = symbols, [score(a + b, _NONE) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) != _NONE:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], _NONE)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], _NONE)
        return parts

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """By a heap of pairs over a linked list of places; a popped pair counts only if both of its symbols are as they were."""
        n, scores, frozen = len(symbols), self.scores, set(self.user)
        alive, prev, after = list(symbols), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple] = []

        def meet(i: int, j: int) -> None:
            if frozen and (alive[i] in frozen or alive[j] in frozen):
                return
            both = alive[i] + alive[j]
            if (score := scores.get(both)) is not None:
                heapq.heappush(heap, (-score, i, j, len(both)))

        for i in range(n - 1):
            meet(i, i + 1)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            if not alive[i] or not alive[j] or len(alive[i]) + len(alive[j]) != size:
                continue
            alive[i], alive[j] = alive[i] + alive[j], ""
            after[i] = k = after[j]
            if k < n:
                prev[k] = i
                meet(i, k)
            if (h := prev[i]) >= 0:
                meet(h, i)
        return [s for s in alive if s]

    def _symbols(self, text: str) -> list[str]:
        if not self.user:
            return list(text)
        cut = re.compile("|".join(re.escape(u) for u in sorted(self.user, key=len, reverse=True)) + "|.", re.S)
        return cut.findall(text)

    def _project(self, normal: bytes, source: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Ids of normalised text and their spans in the original."""
        ids, begins, ends, at, was_unknown = [], [], [], 0, False
        for piece in self.merge(self._symbols(normal.decode())):
            raw = piece.encode()
            begin, end = source[at], source[at + len(raw)]
            at += len(raw)
            known = self.index.get(piece)
            if known is not None:
                ids.append(known), begins.append(begin), ends.append(end)
            elif self.fallback:  # the last byte stands for the character
                ids += [self.byte_ids[b] for b in raw]
                begins += [begin] * len(raw)
                ends += [begin] * (len(raw) - 1) + [end]
            elif was_unknown:
                ends[-1] = end
            else:
                ids.append(self.unknown), begins.append(begin), ends.append(end)
            was_unknown = known is None
        return ids, begins, ends

    def _unit(self, text: str, first: bool) -> Unit:
        """A part of a text; ``first`` is the one at its start, which takes the dummy prefix."""
        if not first and MARK not in text:
            return self._plain(text)
        if first:
            normal, source = self.normaliser.normalise(text)
        else:
            out, source, at = bytearray(), [], 0
            for c in text:
                escaped = self.normaliser.mark if c == " " else c.encode()
                out += escaped
                source += [at] * len(escaped)
                at += len(c.encode())
            normal, source = bytes(out), [*source, at]
        ids, begins, ends = self._project(normal, source)
        return Unit(_packed(ids), _packed([e - b for b, e in zip(begins, ends)]), len(ids), begins[0] if begins else 0, self.decode(ids, start=first))

    def _plain(self, text: str) -> Unit:
        """A part without marks of its own: a mark in a piece is a blank, one byte of the text, and all else stands for itself."""
        parts = self.merge([*text.replace(" ", MARK)])
        ids = [*map(self.index.get, parts)]
        if text.isascii() and None not in ids:
            return Unit(_packed(ids), _packed([*map(len, parts)]), len(ids), 0, self.decode(ids, start=False))
        found, lengths = [], []
        for piece, i in zip(parts, ids):
            size = len(piece.replace(MARK, " ").encode())
            if i is not None:
                found.append(i), lengths.append(size)
            elif self.fallback:
                found += [self.byte_ids[b] for b in piece.encode()]
                lengths += [0] * (size - 1) + [size]
            elif found and found[-1] == self.unknown:
                lengths[-1] += size
            else:
                found.append(self.unknown), lengths.append(size)
        return Unit(_packed(found), _packed(lengths), len(found), 0, self.decode(found, start=False))

    def units(self, text: str) -> list[Unit]:
        """The text's parts, in order."""
        if not text:
            return []
        if not self.apart:
            return [self._unit(text, True)]
        head, *rest = self.parts.findall(text)
        return [self._first[head], *map(self._later.__getitem__, rest)]

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids with the first and one past the last byte of each."""
        units = self.units(text)
        ids = np.frombuffer(b"".join(u.ids for u in units), dtype="<i4").tolist()
        ends = (sum(u.lead for u in units) + np.cumsum(np.frombuffer(b"".join(u.lengths for u in units), dtype="<i4"))).tolist()
        return ids, [sum(u.lead for u in units), *ends[:-1]] if ends else [], ends

    def decode(self, ids: list[int], start: bool = True) -> str:
        """The text of ids: marks become blanks (the first is dropped at the start of a text), bytes are joined to characters, control ids say nothing."""
        if not start and not self.odd.intersection(ids):
            return "".join([self.pieces[i] for i in ids]).replace(MARK, " ")
        out: list[str] = []
        pending, bos, dropped = bytearray(), start, False

        def flush() -> None:
            if pending:
                out.append(_characters(bytes(pending)))
                pending.clear()

        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                pending.append(self.byte_of[i])
                continue
            flush()
            if dropped or any(out):
                bos = False
            dropped = False
            if kind == CONTROL:
                continue
            if kind == UNKNOWN:
                out.append(self.unknown_text)
                continue
            piece = self.pieces[i]
            if bos and self.strips and piece.startswith(MARK):
                piece, dropped = piece[len(MARK) :], not self.normaliser.squeeze
            out.append(piece.replace(MARK, " "))
        flush()
        return "".join(out)


def _parts(pieces) -> re.Pattern:
    """Blanks (or marks) and what follows them up to the next; where no piece joins a letter to another character, up to that change too.

    Letters that some piece does join to others count as others.
    """
    letter, other = r"[^\W\d_]", r"[\W\d_]"
    mixed = [p for p in (p.replace(MARK, "") for p in pieces) if re.search(f"{letter}{other}|{other}{letter}", p)]
    odd = "".join(sorted({c for p in mixed for c in p if re.fullmatch(letter, c)}))
    if len(odd) > 64 or re.search("[A-Za-z]", odd):
        return re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
    odd = re.escape(odd)
    return re.compile(rf"[ {MARK}]*(?:[^\W\d_{odd}]+|(?:[^\w {MARK}]|[\d_{odd}])+)|[ {MARK}]+")


def _characters(data: bytes) -> str:
    """Each character that the bytes spell, and a replacement for each byte that belongs to none."""
    out, at = [], 0
    while at < len(data):
        first = data[at]
        n = 1 if first < 0x80 else 2 if 0xC0 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF8 else 1
        try:
            out.append(data[at : at + n].decode())
            at += n
        except UnicodeDecodeError:
            out.append(BROKEN)
            at += 1
    return "".join(out)


class _Known(dict):
    """Units by text, kept until the dictionary is full; long ones hardly come again."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> Unit:
        made = self.make(key)
        if len(self) < CACHE_ENTRIES and len(key) <= CACHE_CHARS:
            self[key] = made
        return made


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """One per Python worker, so that its caches outlive a task."""
    return PieceModel(path)
