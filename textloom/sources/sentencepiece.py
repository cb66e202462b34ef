"""SentencePiece models, read from their wire format; their encoding and decoding without the library."""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from ..operators.kernels import Unigram

# Piece types and field numbers of the model's format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM_MODEL, BPE_MODEL = 1, 2
SPACE = "▁"
UNKNOWN_TEXT = " ⁇ ".encode()  #: what an unknown piece decodes to
MEMO = 32 << 20  #: bytes of words and ids that a worker remembers of a model


def _fields(blob: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = blob[at]
            at += 1
            n |= (b & 127) << shift
            if b < 128:
                return n
            shift += 7

    while at < len(blob):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, blob[at : at + n]
            at += n


@dataclass
class SentencePiece:
    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM_MODEL
    byte_fallback: bool = False
    unk_id: int = 0
    bos_id: int = 1
    eos_id: int = 2
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    options: dict = field(default_factory=dict)  #: nbest_size, alpha, seed, add_bos, add_eos, reverse

    @classmethod
    def read(cls, blob: bytes, **options) -> SentencePiece:
        m = cls([], options=options)
        for number, x in _fields(blob):
            if number == 1:
                piece = dict(_fields(x))
                m.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                t = dict(_fields(x))
                m.kind, m.byte_fallback = t.get(3, UNIGRAM_MODEL), bool(t.get(35, 0))
                signed = lambda v: v - (1 << 64) if v >> 63 else v
                m.unk_id, m.bos_id, m.eos_id = (signed(t.get(k, d)) for k, d in ((40, 0), (41, 1), (42, 2)))
            elif number == 3:
                t = dict(_fields(x))
                m.charsmap = t.get(2, b"")
                m.dummy_prefix, m.squeeze, m.escape = (bool(t.get(k, 1)) for k in (3, 4, 5))
        return m

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, (p, _, _) in enumerate(self.pieces)}

    @cached_property
    def model(self) -> Unigram:
        known = [(p if t in (NORMAL, USER) else "", s) for p, s, t in self.pieces]
        if any(t == USER for _, _, t in self.pieces):
            top = max((s for _, s, t in self.pieces if t == NORMAL), default=0.0)
            known = [(p, top * len(p.encode()) - 0.1 if t == USER else s) for (p, s), (_, _, t) in zip(known, self.pieces, strict=True)]
        low = min((s for _, s, t in self.pieces if t == NORMAL), default=0.0)
        m = Unigram(known, self.unk_id, min_score=low)
        return m

    @cached_property
    def chars(self) -> CharsMap | None:
        return CharsMap(self.charsmap) if self.charsmap else None

    def normalize(self, text: str) -> str:
        if self.chars:
            text = self.chars.apply(text)
        if self.squeeze:
            text = " ".join(p for p in text.split(" ") if p)
        if self.dummy_prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def _spell(self, text: str) -> list[int]:
        spelled = [self.ids.get(f"<0x{b:02X}>") for b in text.encode()] if self.byte_fallback else [None]
        return [self.unk_id] if None in spelled else spelled

    def _bpe(self, text: str) -> list[int]:
        """Merge the neighbours whose union has the best score, leftmost first, until none is known."""
        part, n = list(text), len(text)
        before, after, heap = list(range(-1, n - 1)), [*range(1, n), n], []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := self.ids.get(both := part[i] + part[j])) is not None and self.pieces[k][2] in (NORMAL, USER):
                heapq.heappush(heap, (-self.pieces[k][1], i, both))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        parts = [p for p in part if p]
        out: list[int] = []
        for p in parts:
            i = self.ids.get(p)
            got = [i] if i is not None and self.pieces[i][2] in (NORMAL, USER) else self._spell(p)
            if not (got == [self.unk_id] and out and out[-1] == self.unk_id):
                out += got
        return out

    @cached_property
    def memo(self) -> tuple[dict[str, list[int]], list[int]]:
        return {}, [MEMO]

    @cached_property
    def by_words(self) -> bool:
        """Whether every segmentation has a boundary before each `▁`, and an id of its own behind it."""
        mark = SPACE.encode()
        return mark in self.model.ids and not any(mark in t[1:] for t in self.model.ids)

    def _words(self, text: str) -> list[int]:
        """The likeliest segmentation word by word: where sums are exact, what comes before a word doesn't change its own."""
        (memo, room), out = self.memo, []
        first, *rest = text.split(SPACE)
        for w in [*([first] if first else []), *(SPACE + w for w in rest)]:
            if (ids := memo.get(w)) is None:
                ids = self.model.encode(w)
                if room[0] > 0:
                    memo[w] = ids
                    room[0] -= 2 * len(w) + 8 * len(ids) + 200
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        o, text = self.options, self.normalize(text)
        if self.kind == BPE_MODEL:
            ids = self._bpe(text)
        else:
            m = self.model
            if self.byte_fallback:
                m.byte_fallback = True
                m.ids.update({p.encode(): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE})
            if o.get("nbest_size", 0) in (0, 1):
                ids = self._words(text) if self.by_words and len(text) * 4 <= m.exact_bytes else m.encode(text)
            else:
                ids = m.sample(text, o.get("alpha", 0.1), o.get("seed", 0))
        if o.get("add_bos"):
            ids = [self.bos_id, *ids]
        if o.get("add_eos"):
            ids = [*ids, self.eos_id]
        return ids[::-1] if o.get("reverse") else ids

    def _text(self, ids) -> bytes:
        out = b""
        for i in ids:
            if not 0 <= i < len(self.pieces):
                continue
            p, _, t = self.pieces[i]
            if t == BYTE:
                out += bytes([int(p[3:5], 16)])
            elif t == UNKNOWN:
                out += UNKNOWN_TEXT
            elif t != CONTROL:
                out += p.replace(SPACE, " ").encode()
        return out

    def decode(self, ids) -> str:
        """The text of the ids that the model has; the blank that encoding put in front is gone."""
        text = self._text(ids).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def decode_part(self, ids) -> bytes:
        """The same for a part of a stream: bytes, and no blank is taken away."""
        return self._text(ids)


class CharsMap:
    """Longest-prefix replacements in the public double-array form: a count of bytes, the array, then strings that end with 0."""

    def __init__(self, blob: bytes):
        (n,) = struct.unpack_from("<I", blob)
        self.units, self.strings = struct.unpack_from(f"<{n // 4}I", blob, 4), blob[4 + n :]

    def find(self, s: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key at a place."""
        units, got = self.units, None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        for i in range(at, len(s)):
            node ^= s[i]
            if node >= len(units) or units[node] & 0x800000FF != s[i]:
                break
            leaf = units[node] >> 8 & 1
            node ^= offset(units[node])
            if leaf:
                begin = units[node] & 0x7FFFFFFF
                got = i + 1 - at, self.strings[begin : self.strings.index(b"\0", begin)]
        return got

    def apply(self, text: str) -> str:
        s, out, at = text.encode("utf-8", "replace"), [], 0
        while at < len(s):
            if got := self.find(s, at):
                out.append(got[1])
                at += got[0]
            else:
                step = 1 if s[at] < 0xC0 else 2 if s[at] < 0xE0 else 3 if s[at] < 0xF0 else 4
                out.append(s[at : at + step])
                at += step
        return b"".join(out).decode("utf-8", "replace")
