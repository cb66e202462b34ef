"""Language-model scoring by deleted interpolation.

The model mixes maximum-likelihood estimates of the bigram, the unigram and the uniform order. The mixture weights
depend on how often the context was seen (one set per power of two) and are learned by expectation-maximisation on
held-out counts: of every five training documents about one is held out from the estimates that predict its tokens.
The weights found so mix the estimates from all training documents. Each batch sends each distinct word and word pair
once, with its counts, to the bucket of its key; the totals come back to the batches that have it. A word's key is its
XXH3 hash of 63 bits: of n different words any two share one with probability n**2 / 2**64. A pair's key has 52 bits of a
hash of both keys, which keeps what is sent small: of n different pairs one shares its count with another one's with
probability n / 2**52, which changes the model's score, but no count of words.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT, U64, Batch, Lanes, batched, chunks, coded, counted, joined, keyed, mix, parts, release, send, settled, table, totals, words

END, START = U64(0x1234567887654320), U64(0x0FEDCBA987654322)  #: keys of the end token and of the context before the first word
TOP = U64(1 << 63)  #: set in pairs' keys only, so they follow all words' keys
PAIR = U64((1 << 63) - (1 << 11))  #: the other bits of a pair's key
STEP = 8  #: bins in a factor of two, for the EM's table of estimates
BUCKETS = 24  #: context-frequency buckets; the last holds all contexts seen 2**23 times or more


def _tokens(b: Batch, fold: bool = True):
    """For each part of a batch: first text, tokens per text, token keys, and keys of (context, token) pairs."""
    for lo, hi in chunks(b.texts, 4_000_000):
        buf, start = joined(b.texts[lo:hi])
        if fold:
            buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
        s, e = words(buf)
        first = np.searchsorted(s, start)
        n = np.diff(first) + 1
        key = np.empty(int(n.sum()), U64)
        end = np.cumsum(n) - 1
        word = np.ones(len(key), bool)
        word[end] = False
        code, names = coded(buf, s, e)
        key[word] = (keyed(names) >> U64(1))[code]
        key[end] = END
        before = np.concatenate([[START], key[:-1]])
        before[end - n + 1] = START
        yield lo, n, key, before, mix(before * U64(0x9E3779B97F4A7C15) + key) & PAIR | TOP


TRAIN, TUNE, HELD = 0, 1, 2  #: roles of documents: tuning ones are training ones too


def _tables(b: Batch):
    """All tokens of the batch, their documents' roles, its distinct keys, and how often each occurs in its training and
    in its tuning documents."""
    got = list(_tokens(b))
    n, key, before, pair = (np.concatenate(x) for x in zip(*(g[1:] for g in got), strict=True))
    role = np.repeat(np.array(b.more[0], np.int8), n)
    u, ui = np.unique(key, return_inverse=True)
    p, pi = np.unique(pair, return_inverse=True)
    count = lambda i, of: np.stack([np.bincount(i, flag, len(of)).astype(np.int64) for flag in (role != HELD, role == TUNE)])
    return n, before, role, u, ui, count(ui, u), p, pi, count(pi, p)


def _quantum(p: np.ndarray) -> np.ndarray:
    """Bin of a probability; 0 is for none."""
    return np.where(p > 0, np.rint(-STEP * np.log2(np.where(p > 0, p, 1))) + 1, 0).astype(np.int64)


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + (c > 0), BUCKETS - 1)


def learn(cells: list[tuple[int, int, int, int]], uniform: float, rounds: int = 60) -> np.ndarray:
    """Weights (bucket; bigram, unigram, uniform) by EM from counts of held-out tokens per (bucket, bin, bin)."""
    out = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    out[0] = [0, 0.8, 0.2]
    x = np.array(cells, np.int64).reshape(-1, 4)
    est = np.stack([np.where(q > 0, 2.0 ** (-(q - 1) / STEP), 0) for q in (x[:, 1], x[:, 2])] + [np.full(len(x), uniform)], axis=1)
    for _ in range(rounds):
        part = est * out[x[:, 0]]
        part *= (x[:, 3] / np.maximum(part.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(x[:, 0], part[:, k], BUCKETS) for k in range(3)], axis=1) + 1e-3  # no order is ruled out
        new[0, 0] = 0
        out = new / new.sum(1, keepdims=True)
    return out


def score(docs: DataFrame, fold: int = 7, held: int = 2, tuning: int = 5) -> DataFrame:
    """Score every text; learn from the documents whose crc32(doc_id as text) mod `fold` isn't `held`.

    Of those, the ones whose crc32 divided by `fold` leaves no remainder by `tuning` are held out to learn the weights.
    A null text is empty: its only token is the end. A null doc_id counts as the empty id. Equal rows get equal
    results. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. If nothing is left to learn
    from, N and V are 0: every token has base probability 1 and score 0; without tuning documents all orders weigh alike."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    role = F.when(F.pmod(crc, F.lit(fold)) == held, HELD).when(F.pmod(F.floor(crc / fold), F.lit(tuning)) == 0, TUNE).otherwise(TRAIN)
    d, n = batched(docs, role)
    d = settled(d)  # three steps read the batches
    release(d)  # nothing names the rows before the checkpoint now, so their shuffle files go before the counts come
    lanes = Lanes.of(n, parts(docs, 2_000_000, 48))

    def tell(group: pa.Table) -> pa.Table:
        b = Batch(group)
        _, _, _, u, _, cu, p, _, cp = _tables(b)
        return send(b.number, np.concatenate([u, p]), lanes.first, *np.concatenate([cu, cp], axis=1))

    def about(keys: np.ndarray, total: np.ndarray, tune: np.ndarray) -> tuple[int, int, int]:
        one = keys < TOP
        return int(total[one].sum()), int((total[one] > 0).sum()), int(tune[one].sum())

    back = settled(counted(d.groupBy("batch").applyInArrow(tell, SENT), lanes, about).repartition(n, "batch"))
    sums = back.where("batch = -1").mapInArrow(lambda it: (pa.RecordBatch.from_pydict(dict(zip("nvt", ([pickle.loads(x)[k] for x in rb.column("blob").to_pylist()] for k in range(3)), strict=True))) for rb in it), "n long, v long, t long")
    big_n, big_v, tuned = (int(x or 0) for x in sums.agg(F.sum("n"), F.sum("v"), F.sum("t")).first())
    back = back.where("batch >= 0")

    def estimates(b: Batch, right: pa.Table):
        """Tokens per text, roles, and for each token the counts of itself, its context and its pair: in all training
        documents, and in the tuning ones among them."""
        n, before, role, u, ui, _, p, pi, _ = _tables(b)
        got = totals(np.concatenate([u, p]), lanes.first, right, 2)
        cu, cp = got[:, : len(u)], got[:, len(u) :]
        at = np.minimum(np.searchsorted(u, before), len(u) - 1)
        ctx = np.where(u[at] == before, cu[:, at], 0)
        ctx[:, before == START] = cu[:, [np.searchsorted(u, END)]]  # as often as a document ends
        return n, role, cu[:, ui], ctx, cp[:, pi]

    def cells(left: pa.Table, right: pa.Table) -> pa.Table:
        _, role, *counts = estimates(Batch(left), right)
        c1, cv, c2 = (c[0, role == TUNE] - c[1, role == TUNE] for c in counts)
        x = np.stack([_bucket(cv), _quantum(c2 / np.maximum(cv, 1)), _quantum(c1 / max(big_n - tuned, 1))])
        x, c = np.unique(x[0] << 40 | x[1] << 20 | x[2], return_counts=True)
        return table("b long, p2 long, p1 long, c long", b=x >> 40, p2=(x >> 20) & 0xFFFFF, p1=x & 0xFFFFF, c=c)

    held_out = d.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(cells, "b long, p2 long, p1 long, c long")
    found = held_out.groupBy("b", "p2", "p1").agg(F.sum("c").alias("c")).collect()  # bounded: BUCKETS x bins x bins
    weight = learn([tuple(r) for r in found], 1 / (big_v + 1))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left)
        n, _, *counts = estimates(b, right)
        c1, cv, c2 = (c[0] for c in counts)
        first = np.cumsum(n) - n
        add = lambda x: np.add.reduceat(x, first)
        w = weight[_bucket(cv)]
        p = w[:, 0] * c2 / np.maximum(cv, 1) + w[:, 1] * c1 / max(big_n, 1) + w[:, 2] / (big_v + 1)
        base = add(np.log10((c1 + 1) / (big_n + big_v + 1)))
        held_ = [r == HELD for r in b.more[0]]
        return table(OUT, doc_id=b.id, held_out=held_, n_tokens=n, n_known=add((c1 > 0).astype(np.int64)), train_tokens=np.full(len(n), big_n), base_score=base, score=add(np.log10(p)) if big_n else np.zeros(len(n)))

    return d.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(scored, OUT)


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
