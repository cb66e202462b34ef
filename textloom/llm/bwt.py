"""Burrows-Wheeler transforms of shards, merged by iterative interleave refinement.

A shard is a cyclic byte text. Its transform lists, in suffix order, the symbol before each suffix; here a symbol is a
run of up to 16 bytes, so one refinement step settles 16 bytes of every suffix. The merge never compares or sorts
suffixes of different shards: it keeps only the *interleave*, the sequence that says from which shard the next suffix
comes, and refines it. One step reads the shards' transforms in the order of the interleave and sorts the shard numbers
stably by the symbols read; after steps of lengths l1, l2, ... the interleave is that of all suffixes sorted by their
first l1 + l2 + ... bytes. The step that first tells two neighbours apart gives their common prefix: all bytes of the
steps before it, and not all of its own. The maximal intervals whose neighbours have common prefixes of at least `depth`
bytes are the repeated intervals of that length.

Each shard is sorted by itself. The merge needs one alphabet of symbols for all shards: the union of their sorted
alphabets, first of symbols of eight bytes, then of pairs of these.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from .common import distinct

HALF, WIDE = 8, 16  #: bytes in half a symbol and in one


def _stable(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order of numbers below 2**32, and the numbers in it: sorted together with their places in one word."""
    bits = np.uint64(len(x).bit_length())
    both = np.sort((x.astype(np.uint64) << bits) | np.arange(len(x), dtype=np.uint64))
    return (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), (both >> bits).astype(np.int64)


def _grams(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, cyclically, as a number that sorts as they do."""
    out = np.zeros(len(text), np.uint64)
    for k in range(HALF):
        out = (out << np.uint64(8)) | np.roll(text, -k)
    return out


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order, and the rank of each value among the different ones."""
    order = np.argsort(x)
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(np.diff(x[order], prepend=x[order[:1]]) != 0)
    return order, rank


def _alphabet(some: Iterable[np.ndarray]) -> np.ndarray:
    return distinct(np.concatenate(list(some)))


class Shard:
    """A text's suffixes sorted by their first `depth` bytes, and the transform's symbols in that order."""

    def __init__(self, text: np.ndarray):
        self.grams = _grams(text)
        self.letters, self.halves = np.unique(self.grams, return_inverse=True)

    def pair(self, letters: np.ndarray) -> None:
        """Symbols as pairs of halves, numbered by the common alphabet of halves."""
        self.halves = half = np.searchsorted(letters, self.letters)[self.halves]
        pairs = (half << 32) | np.roll(half, -HALF)
        order, self.ids = _ranked(pairs)
        self.symbols = pairs[order[np.diff(self.ids[order], prepend=-1) != 0]]

    def sort(self, depth: int) -> None:
        order, rank, have = None, self.ids, WIDE
        while have < depth:
            step = min(have, depth - have)
            order, rank = _ranked((rank << 32) | np.roll(rank, -step))
            have += step
        self.suffixes = np.argsort(rank) if order is None else order

    def steps(self, symbols: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
        """Bytes and symbols of each refinement step: the symbol before each suffix, as its number in the common alphabet."""
        out = [(WIDE, np.searchsorted(symbols, self.symbols)[self.ids[self.suffixes - WIDE]])] * (depth // WIDE)
        rest = depth % WIDE
        for n in [k for k in (min(rest, HALF), max(rest - HALF, 0)) if k]:
            at = self.suffixes - n
            out.append((n, self.halves[at] if n == HALF else (self.grams[at] >> np.uint64(8 * (HALF - n))).astype(np.int64)))
        return out[::-1]


def build(texts: list[np.ndarray], depth: int) -> tuple[list[Shard], np.ndarray]:
    """The shards' transforms, and their common alphabet of symbols."""
    shards = [Shard(t) for t in texts]
    letters = _alphabet(s.letters for s in shards)
    for s in shards:
        s.pair(letters)
        s.sort(depth)
    return shards, _alphabet(s.symbols for s in shards)


def merge(shards: list[Shard], symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of all shards' suffixes, and each suffix's common prefix with the one before it, in bytes of whole steps."""
    z = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.suffixes) for s in shards])
    block, have = np.zeros(len(z), np.int64), 0
    common = np.full(len(z), depth)
    common[:1] = 0
    for step in zip(*(s.steps(symbols, depth) for s in shards), strict=True):
        if len(shards) > 1:
            symbol = np.empty(len(z), np.int64)
            symbol[np.argsort(z, kind="stable")] = np.concatenate([x for _, x in step])
        else:
            symbol = step[0][1]
        order, symbol = _stable(symbol)
        z, block = z[order], block[order]
        apart = np.concatenate([[False], (np.diff(block) != 0) | (np.diff(symbol) != 0)])[: len(z)]
        common[apart] = np.minimum(common[apart], have)  # an earlier step's depth stays
        block = np.cumsum(apart)
        have += step[0][0]
    return z, common


def intervals(common: np.ndarray, depth: int) -> np.ndarray:
    """The number of each suffix's interval: neighbours share it if they share `depth` bytes."""
    return np.cumsum(common < depth)


def classes(texts: list[bytes], depth: int, shard_bytes: int = 1 << 19) -> list[np.ndarray]:
    """For each text, the class of each window of `depth` bytes in it: equal windows, wherever they are, share a class."""
    if depth < 1:
        raise ValueError("windows have at least one byte")
    groups: list[list[bytes]] = [[]]
    size = 0
    for t in texts:
        if size and size + len(t) > shard_bytes and len(groups) < 65_000:
            groups.append([])
            size = 0
        groups[-1].append(t)
        size += len(t)
    shards, symbols = build([np.frombuffer(b"".join(g) + bytes(depth), np.uint8) for g in groups], depth)
    z, common = merge(shards, symbols, depth)
    number = intervals(common, depth)
    out: list[np.ndarray] = []
    rows = np.argsort(z, kind="stable")
    cut = np.cumsum([0] + [len(s.suffixes) for s in shards])
    for g, s, i, j in zip(groups, shards, cut, cut[1:], strict=False):
        of = np.empty(j - i, np.int64)
        of[s.suffixes] = number[rows[i:j]]
        at = 0
        for t in g:
            out.append(of[at : at + max(0, len(t) - depth + 1)])
            at += len(t)
    return out
