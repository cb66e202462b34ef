"""Sub-word models as plain Python: a model turns one piece into token ids. Models work on UTF-8 bytes, so byte-level
vocabularies need no detour through an alphabet of printable characters."""

from __future__ import annotations

import heapq
import math
import random
import zlib
from array import array
from collections.abc import Iterable, Mapping
from functools import cached_property

import numpy as np


def as_bytes(token: str | bytes) -> bytes:
    return token if isinstance(token, bytes) else token.encode("utf-8", "surrogatepass")


class Longest:
    """The longest known token at a place: tokens by length, longest first, for each two bytes that they begin with."""

    def __init__(self, tokens: Iterable[bytes]):
        sizes: dict[bytes, dict[int, set[bytes]]] = {}
        self.single: set[bytes] = set()
        for t in tokens:
            if len(t) > 1:
                sizes.setdefault(t[:2], {}).setdefault(len(t), set()).add(t)
            elif t:
                self.single.add(t)
        self.longer = {b: sorted(s.items(), reverse=True) for b, s in sizes.items()}

    def at(self, s: bytes, i: int) -> bytes | None:
        for n, some in self.longer.get(s[i : i + 2], ()):
            if (t := s[i : i + n]) in some:
                return t
        return t if (t := s[i : i + 1]) in self.single else None

    def all_at(self, s: bytes, i: int) -> list[bytes]:
        found = [t for n, some in self.longer.get(s[i : i + 2], ()) if (t := s[i : i + n]) in some]
        return [*found, t] if (t := s[i : i + 1]) in self.single else found


class WordPiece:
    """Longest known prefix, then longest known continuations; a word that can't be built so, or is too long, is unknown."""

    def __init__(self, vocab: Mapping[str, int], unk_id: int, prefix: str = "##", max_bytes: int = 100):
        self.unk_id, self.prefix, self.max_bytes = unk_id, prefix, max_bytes
        self.first, self.rest = {}, {}
        for t, i in vocab.items():
            if prefix and t.startswith(prefix):
                self.rest[as_bytes(t[len(prefix) :])] = i
            else:
                self.first[as_bytes(t)] = i

    @cached_property
    def tries(self):
        return Longest(self.first), Longest(self.rest)

    def encode(self, piece: str) -> list[int]:
        s = as_bytes(piece)
        if len(s) > self.max_bytes:
            return [self.unk_id]
        out, at, (trie, rest), ids = [], 0, self.tries, self.first
        while at < len(s):
            t = trie.at(s, at)
            if t is None:
                return [self.unk_id]
            out.append(ids[t])
            at += len(t)
            trie, ids = rest, self.rest
        return out


class Trie:
    """Greedy longest match over bytes. A byte that begins no token gives `unk_id`."""

    def __init__(self, vocab: Mapping[str | bytes, int], unk_id: int = -1):
        self.ids, self.unk_id = {as_bytes(t): i for t, i in vocab.items() if t}, unk_id

    @cached_property
    def trie(self):
        return Longest(self.ids)

    def encode(self, piece: str | bytes) -> list[int]:
        s, out, at = as_bytes(piece), [], 0
        while at < len(s):
            t = self.trie.at(s, at)
            out.append(self.unk_id if t is None else self.ids[t])
            at += 1 if t is None else len(t)
        return out


class BPE:
    """Byte-pair merges by rank; of equal ranks the pair that arose first goes first.

    A piece begins as longest matches of the tokens that no merge makes, so base and added tokens may be long. A byte
    that none of them covers is its `<0xNN>` token (byte_fallback), else unk, else nothing."""

    def __init__(self, vocab: Mapping[str | bytes, int], merges: Iterable[tuple[str | bytes, str | bytes]], unk_id: int | None = None, fuse_unk: bool = False, end_suffix: str = "", byte_fallback: bool = False, added: Mapping[str | bytes, int] | None = None):
        self.ids = {as_bytes(t): i for t, i in vocab.items()}
        self.merges = [(as_bytes(a), as_bytes(b)) for a, b in merges]
        for a, b in self.merges:
            if a not in self.ids or b not in self.ids or a + b not in self.ids:
                raise ValueError(f"a merge needs both parts and their union in the vocabulary: {a!r} {b!r}")
        made = {a + b for a, b in self.merges}
        self.base = {t for t in self.ids if t not in made}
        for t, i in (added or {}).items():
            if as_bytes(t) not in self.ids:
                self.ids[as_bytes(t)] = i
                self.base.add(as_bytes(t))
        self.unk_id, self.fuse_unk, self.end, self.byte_fallback = unk_id, fuse_unk, as_bytes(end_suffix), byte_fallback

    @cached_property
    def ready(self):
        rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(self.merges):
            rank.setdefault((self.ids[a], self.ids[b]), (r, self.ids[a + b]))
        return Longest(self.base), rank

    def start(self, s: bytes) -> list[int]:
        out, at, trie, unknown = [], 0, self.ready[0], False
        while at < len(s):
            t = trie.at(s, at)
            if t is not None:
                out.append(self.ids[t])
                at, unknown = at + len(t), False
                continue
            spare = self.ids.get(b"<0x%02X>" % s[at]) if self.byte_fallback else None
            if spare is not None:
                out.append(spare)
            elif self.unk_id is not None and not (self.fuse_unk and unknown):
                out.append(self.unk_id)
            at, unknown = at + 1, spare is None
        return out

    def encode(self, piece: str | bytes) -> list[int]:
        ids = self.start(as_bytes(piece) + self.end)
        n, (_, rank) = len(ids), self.ready
        if n < 2:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        live, heap, born = [True] * n, [], 0

        def offer(i: int, j: int) -> None:
            nonlocal born
            if (got := rank.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (got[0], born, i, j, ids[i], ids[j], got[1]))
                born += 1

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, _, i, j, a, b, new = heapq.heappop(heap)
            if not (live[i] and live[j]) or ids[i] != a or ids[j] != b or after[i] != j:
                continue
            ids[i], live[j] = new, False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            if before[i] >= 0:
                offer(before[i], i)
            if k >= 0:
                offer(i, k)
        return [x for x, on in zip(ids, live, strict=True) if on]


_LEAD = [1] * 0xC0 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10


class Unigram:
    """The likeliest segmentation by float32 scores; of equal ones the token that starts earliest wins.

    A character that no single-character token covers costs min_score - 10; unknowns in a row are one id. With
    byte_fallback they are their bytes' `<0xNN>` tokens instead."""

    def __init__(self, vocab: list[tuple[str | bytes, float]] | Mapping, unk_id: int, byte_fallback: bool = False, min_score: float | None = None):
        pairs = list(vocab)
        self.ids, self.scores = {}, [float(np.float32(s)) for _, s in pairs]
        for i, (t, _) in enumerate(pairs):
            if t and i != unk_id:
                self.ids.setdefault(as_bytes(t), i)
        self.unk_id, self.byte_fallback = unk_id, byte_fallback
        lowest = min((s for i, (_, s) in enumerate(pairs) if i != unk_id), default=0.0) if min_score is None else min_score
        self.unk_score = float(np.float32(lowest) - np.float32(10))

    @cached_property
    def trie(self):
        return Longest(self.ids)

    def lattice(self, s: bytes) -> Iterable[tuple[int, list[tuple[int, int, float]]]]:
        """For each place that a character begins at: (end, id, score) of the tokens there."""
        at = 0
        while at < len(s):
            step = min(_LEAD[s[at]], len(s) - at)
            edges = [(at + len(t), self.ids[t], self.scores[self.ids[t]]) for t in reversed(self.trie.all_at(s, at))]
            if not any(end == at + step for end, _, _ in edges):
                edges.append((at + step, self.unk_id, self.unk_score))
            yield at, edges
            at += step

    def _read(self, s: bytes, path: list[tuple[int, int, int]]) -> list[int]:
        out: list[int] = []
        for start, end, i in path:
            if i != self.unk_id:
                out.append(i)
            elif self.byte_fallback and all(b"<0x%02X>" % b in self.ids for b in s[start:end]):
                out += [self.ids[b"<0x%02X>" % b] for b in s[start:end]]
            elif not out or out[-1] != self.unk_id:
                out.append(self.unk_id)
        return out

    @cached_property
    def scored(self) -> tuple[dict[bytes, tuple[int, float]], dict[bytes, list[tuple[int, dict[bytes, tuple[int, float]]]]]]:
        """(id, score) of the tokens of one byte, and of the longer ones by their first two bytes and their length."""
        of = lambda t: (self.ids[t], self.scores[self.ids[t]])
        return {t: of(t) for t in self.trie.single}, {b: [(n, {t: of(t) for t in some}) for n, some in sizes] for b, sizes in self.trie.longer.items()}

    def encode(self, piece: str | bytes) -> list[int]:
        s, (single, longer) = as_bytes(piece), self.scored
        # what is stored in an array of floats is rounded to 32 bits, as a sum of two of them would be
        n, sums, at = len(s), array("f", [0.0]), 0
        best = array("f", [-math.inf]) * (n + 1)
        best[0] = 0.0
        come: list = [None] * (n + 1)
        while at < n:  # as `lattice` says, without its lists
            step = min(_LEAD[s[at]], n - at)
            if (so_far := best[at]) != -math.inf:
                known = False
                for size, some in longer.get(s[at : at + 2], ()):
                    if (got := some.get(s[at : at + size])) is not None:
                        known, end = known or size == step, at + size
                        sums[0] = so_far + got[1]
                        if sums[0] > best[end]:
                            best[end], come[end] = sums[0], (at, end, got[0])
                if (got := single.get(s[at : at + 1])) is not None:
                    known, end = known or step == 1, at + 1
                    sums[0] = so_far + got[1]
                    if sums[0] > best[end]:
                        best[end], come[end] = sums[0], (at, end, got[0])
                if not known:
                    end = at + step
                    sums[0] = so_far + self.unk_score
                    if sums[0] > best[end]:
                        best[end], come[end] = sums[0], (at, end, self.unk_id)
            at += step
        path, end = [], n
        while end > 0:
            path.append(come[end])
            end = come[end][0]
        return self._read(s, path[::-1])

    @cached_property
    def exact_bytes(self) -> int:
        """Up to how many bytes of text every sum of scores is exact in 32 bits: scores are multiples of a power of two then. 0: none."""
        scores = [*(self.scores[i] for i in self.ids.values()), self.unk_score]
        grain = max(s.as_integer_ratio()[1] for s in scores) if all(map(math.isfinite, scores)) else math.inf
        return int((1 << 24) / grain / max(1.0, *map(abs, scores))) if grain < 1 << 24 else 0

    def sample(self, piece: str | bytes, alpha: float, seed: int = 0) -> list[int]:
        """A segmentation drawn in proportion to its probability to the power alpha; the same text and seed give the same."""
        s = as_bytes(piece)
        r = random.Random(zlib.crc32(s) ^ seed)
        into: list[list] = [[] for _ in range(len(s) + 1)]
        total = [-np.inf] * (len(s) + 1)
        total[0] = 0.0
        for at, edges in self.lattice(s):
            if total[at] == -np.inf:
                continue
            for end, i, score in edges:
                w = total[at] + alpha * float(score)
                into[end].append((w, at, i))
                total[end] = float(np.logaddexp(total[end], w))
        path, end = [], len(s)
        while end > 0:
            u, chosen = r.random(), into[end][-1]
            for w, at, i in into[end]:
                u -= np.exp(w - total[end])
                if u <= 0:
                    chosen = (w, at, i)
                    break
            path.append((chosen[1], end, chosen[2]))
            end = chosen[1]
        return self._read(s, path[::-1])


class WordLevel:
    """Whole pieces, by exact look-up."""

    def __init__(self, vocab: Mapping[str, int], unk_id: int = -1):
        self.ids, self.unk_id = dict(vocab), unk_id

    def encode(self, piece: str) -> list[int]:
        return [self.ids.get(piece, self.unk_id)]


def merges_from_ranks(ranks: Mapping[bytes, int]) -> tuple[list[tuple[bytes, bytes]], dict[bytes, int]]:
    """The merges behind a ranked vocabulary, and the tokens that no merge makes.

    A token is cut by the merges of lower rank; if two parts are left, they are its merge."""
    merges, alone = [], {}
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            found = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(rank, 0))
            if found[0] >= rank:
                break
            i = found[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2 and all(p in ranks for p in parts):
            merges.append((parts[0], parts[1]))
        else:
            alone[token] = rank
    return merges, alone
