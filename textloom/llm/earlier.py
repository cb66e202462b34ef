"""Windows that also start earlier: the plan shared by the byte (suffix-array) and the word (super-k-mer) operator.

Equal windows have the same minimiser at the same place. So each run of consecutive windows with one minimiser is
packed as one string and sent to the minimiser's bucket, where equal windows meet and are compared themselves: hashes
only say where a string goes. Before that, minimisers are counted exactly: a window whose minimiser occurs once occurs
once, and doesn't travel. A batch sends each distinct string once; its other copies are decided in the batch, since an
earlier copy is at hand. The runs of a minimiser that occurs more than `hot` times may have too many different
surroundings for one bucket: they are cut again where a second minimiser, by another order, changes, and go to the
bucket of both; so on by a third order and more, one for each factor by which the minimiser is too frequent.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .common import SENT, U64, Batch, Lanes, Prefix, batched, chunks, counted, distinct, joined, mix, parts, post, relayed, send, totals, unpack, words


HOT = 2000


@dataclass(frozen=True)
class Rule:
    size: int  #: units in a window
    gram: int  #: units in a minimiser
    by_word: bool  #: units are words, else bytes
    by_place: bool  #: an earlier start in the same document counts too
    classes: Callable[[list[bytes], int], list[np.ndarray]]  #: the class of each window of each string
    hot: int  #: occurrences of a minimiser up to which its runs meet in one bucket


class Units:
    """Units of some texts: their bytes, where each starts and ends, its text, and each text's first unit."""

    def __init__(self, texts: list[bytes], by_word: bool):
        buf, start = joined(texts)
        if by_word:
            s, e = words(buf)
            keep = np.zeros(len(buf), bool)
            d = np.zeros(len(buf) + 1, np.int8)
            d[s], d[e] = 1, -1
            keep = np.cumsum(d[:-1], dtype=np.int8).astype(bool)
            keep[e] = True
            self.buf = buf[keep]
            n = np.cumsum(e - s + 1)
            self.e = n - 1
            self.s = self.e - (e - s)
            self.buf[self.e] = 32
            self.first = np.searchsorted(s, start)
        else:
            self.buf = buf
            blank = np.zeros(len(buf), bool)
            blank[start[1:] - 1] = True
            self.s = np.flatnonzero(~blank)
            self.e = self.s + 1
            self.first = start - np.arange(len(start))
        self.text = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))


def _sliding(key: np.ndarray, w: int) -> np.ndarray:
    size, n = 1, len(key) - w + 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[:n], key[w - size : w - size + n])


_PLACE = U64(0xFFFFFFFF)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """For each w neighbours the place of the least upper half; of equal ones the first."""
    return (_sliding((h & ~_PLACE) | np.arange(len(h), dtype=U64), w) & _PLACE).astype(np.int64)


def _runs(u: Units, rule: Rule, hashed: Prefix) -> tuple[np.ndarray, ...]:
    """First and last window of each run, its minimiser's hash, and the hashes of all grams."""
    n, m = len(u.s) - rule.size + 1, rule.gram
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64), none.astype(U64)
    h = hashed.of(u.s[: len(u.s) - m + 1], u.e[m - 1 :])
    at = _least(h, rule.size - m + 1)
    at[u.text[:n] != u.text[rule.size - 1 :]] = -1
    begin = np.flatnonzero(np.concatenate([[True], np.diff(at) != 0]))
    end = np.concatenate([begin[1:], [n]]) - 1
    real = at[begin] >= 0
    begin, end = begin[real], end[real]
    return begin, end, h[at[begin]], h


def _refined(rule: Rule, h: np.ndarray, begin: np.ndarray, end: np.ndarray, key: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs cut by the minimisers of as many further orders as their minimiser's total asks for, with the key of them all."""
    w = rule.size - rule.gram + 1
    orders = sum((total > limit).astype(np.int64) for limit in (rule.hot * w**i for i in range(8)))
    size = end - begin + 1
    run = np.repeat(np.arange(len(begin)), size)
    win = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[run]
    new, key = np.diff(run, prepend=-1) != 0, key[run]
    for k in range(1, int(orders.max(initial=0)) + 1):
        other = mix(h + U64(k) * U64(0x9E3779B97F4A7C15))
        at, use = _least(other, w)[win], orders[run] >= k
        new |= use & (np.diff(at, prepend=-1) != 0)
        key = np.where(use, mix(key ^ (other[at] | U64(1))), key)
    first = np.flatnonzero(new)
    return win[first], win[np.append(first[1:], len(win))[: len(first)] - 1], key[first]


def _parts(b: Batch, rule: Rule):
    for lo, hi in chunks(b.texts):
        yield lo, hi, Units(b.texts[lo:hi], rule.by_word)


def find(docs: DataFrame, rule: Rule, out: str, finish: Callable[[Batch, list], pa.Table], *more: Column) -> DataFrame:
    """finish() gets a batch and, per document, the (start, count) arrays of its windows that also start earlier."""
    d, n = batched(docs, *more)
    nb = parts(docs, 3_000_000, 48)
    there, home = Lanes.of(n, nb), Lanes.of(nb, n)

    def minimisers(group: pa.Table) -> pa.Table:
        b = Batch(group)
        found = []
        for _, _, u in _parts(b, rule):
            begin, _, h, _ = _runs(u, rule, Prefix(u.buf))
            if not rule.by_place:  # the same document again doesn't count
                pair = np.unique(h ^ (u.text[begin].astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True)[1]
                h = h[pair]
            found.append(h)
        keys, c = np.unique(np.concatenate([*found, np.zeros(0, U64)]), return_counts=True)
        return send(b.number, keys, there.first, c)

    def strings(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left)
        runs = []
        for lo, _, u in _parts(b, rule):
            runs.append((lo, u, *_runs(u, rule, Prefix(u.buf))))
        keys = distinct(np.concatenate([*(r[4] for r in runs), np.zeros(0, U64)]))
        total = totals(keys, there.first, right)
        done: list[np.ndarray] = []
        ids: dict[bytes, int] = {}
        occ: list[tuple] = []
        for lo, u, begin, end, h, grams in runs:
            t = total[np.searchsorted(keys, h)]
            use = t > 1
            begin, end, h = _refined(rule, grams, begin[use], end[use], h[use], t[use])
            s, e, data = u.s[begin].tolist(), u.e[end + rule.size - 1].tolist(), u.buf.tobytes()
            cid = np.array([ids.setdefault(data[i:j], len(ids)) for i, j in zip(s, e, strict=True)], np.int64)
            doc = u.text[begin] + lo
            occ.append((cid, doc, b.doc[doc], begin - u.first[doc - lo], end - begin + 1, h))
        rows = defaultdict(list)
        if occ:
            cid, doc, key, at, count, h = (np.concatenate(x) for x in zip(*occ, strict=True))
            first = _earliest(cid, key, at if rule.by_place else None)
            done.append(np.stack([doc[~first], at[~first], count[~first]]))
            cid, doc, key, at, count, h = (x[first] for x in (cid, doc, key, at, count, h))
            names = list(ids)
            bucket = (h >> U64(40)) % U64(nb)
            order = np.argsort(bucket, kind="stable")
            for g in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                if len(g):
                    c, inv = np.unique(cid[g], return_inverse=True)
                    own = np.empty(len(c), U64)
                    own[inv] = h[g]
                    rows[int(bucket[g[0]])].append((own, [names[x] for x in c], inv.astype(np.int32), doc[g].astype(np.int32), key[g], at[g], count[g].astype(np.int32)))
        if done and (gone := np.concatenate(done, axis=1)).size:
            rows[-1 - b.number].append(gone)
        return post(b.number, rows, there)

    def meet(group: pa.Table) -> pa.Table:
        """What also starts earlier, for each batch: documents, first windows, counts."""
        back: dict[int, list[np.ndarray]] = defaultdict(list)
        strs = []
        for blob in group.column("blob").to_pylist():
            for to, k, entries in unpack(blob):
                if to < 0:
                    back[k] += entries  # decided in the batch
                else:
                    strs += [(k, x) for x in entries]
        if strs:
            _strings(strs, rule, back)
        return post(abs(group.column("bucket")[0].as_py()), {k: np.concatenate(x, axis=1) for k, x in back.items()}, home)

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left)
        gone = [x for blob in right.column("blob").to_pylist() for _, _, x in unpack(blob)]
        doc, at, count = np.concatenate([*gone, np.zeros((3, 0), np.int64)], axis=1)
        order = np.argsort(doc, kind="stable")
        doc, at, count = doc[order], at[order], count[order]
        cut = np.searchsorted(doc, np.arange(len(b.texts) + 1))
        return finish(b, [(at[i:j], count[i:j]) for i, j in zip(cut, cut[1:], strict=False)])

    back = counted(d.groupBy("batch").applyInArrow(minimisers, SENT), there)
    sent = d.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(strings, SENT)
    late = relayed(relayed(sent, there).groupBy("bucket").applyInArrow(meet, SENT), home)
    return d.groupBy("batch").cogroup(late.groupBy("bucket")).applyInArrow(finished, out)


def _earliest(cls: np.ndarray, key: np.ndarray, at: np.ndarray | None) -> np.ndarray:
    """Which have the least (key, at) of their class; ties all do."""
    if not len(cls):
        return np.zeros(0, bool)
    order = np.lexsort((key, cls)) if at is None else np.lexsort((at, key, cls))
    c = cls[order]
    head = np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(c) != 0]), np.arange(len(c)), 0))
    same = key[order] == key[order][head]
    if at is not None:
        same &= at[order] == at[order][head]
    out = np.empty(len(cls), bool)
    out[order] = same
    return out


def _strings(strs: list, rule: Rule, back: dict[int, list[np.ndarray]]) -> None:
    ids: dict[bytes, int] = {}
    anchor: list[int] = []
    occ = []
    for k, (own, names, inv, doc, key, at, count) in strs:
        to = np.empty(len(names), np.int64)
        for i, (name, a) in enumerate(zip(names, own.tolist(), strict=True)):
            to[i] = ids.setdefault(name, len(ids))
            if to[i] == len(anchor):
                anchor.append(a)
        occ.append((to[inv], np.full(len(inv), k), doc, key, at, count))
    cid, k, doc, key, at, count = (np.concatenate(x) for x in zip(*occ, strict=True))
    first = _earliest(cid, key, at if rule.by_place else None)
    gone = [(k[~first], doc[~first], at[~first], count[~first])]
    # strings that share a minimiser with others: their windows are compared
    _, inv, many = np.unique(np.array(anchor, U64), return_inverse=True, return_counts=True)
    multi = np.flatnonzero(many[inv] > 1)
    if len(multi):
        names = list(ids)
        cls = rule.classes([names[i] for i in multi], rule.size)
        size = np.array([len(c) for c in cls])
        if size.sum():
            one = np.full(len(ids), -1)
            one[cid[first]] = np.flatnonzero(first)
            own_key, own_at = np.repeat(key[one[multi]], size), np.repeat(at[one[multi]], size)
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            early = _earliest(np.concatenate(cls), own_key, own_at + step if rule.by_place else None)
            base = np.full(len(ids), -1)
            base[multi] = np.cumsum(size) - size
            length = np.zeros(len(ids), np.int64)
            length[multi] = size
            late = np.concatenate([[0], np.cumsum(~early)])
            for o in np.flatnonzero(first & (base[cid] >= 0)):
                i, n = base[cid[o]], length[cid[o]]
                if late[i + n] > late[i]:
                    w = np.flatnonzero(~early[i : i + n])
                    gone.append((np.full(len(w), k[o]), np.full(len(w), doc[o]), at[o] + w, np.ones(len(w), np.int64)))
    k, doc, at, count = (np.concatenate(x).astype(np.int64) for x in zip(*gone, strict=True))
    order = np.argsort(k, kind="stable")
    for g in np.split(order, np.flatnonzero(np.diff(k[order])) + 1):
        if len(g):
            back[int(k[g[0]])].append(np.stack([doc[g], at[g], count[g]]))


def covered(n: int, at: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """Which of n units a window covers."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, at, 1)
    np.add.at(d, at + count - 1 + size, -1)
    return np.cumsum(d[:n]) > 0
