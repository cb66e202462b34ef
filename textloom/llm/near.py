"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles, in bands, verified exactly.

A shingle is five consecutive words (all words of a shorter text). Its weight is its count in the text times the mean
inverse document frequency of its words, over all documents. Samples are drawn so that two texts share one with the
probability of their weighted Jaccard similarity; texts that agree on all samples of a band are candidates, and the
candidates' similarity is then computed from all their shingles. Equal texts are one from the start.

Within a band's bucket all texts are first compared with one leader, the text that meets most others in all bands: of
copies with edits that is mostly the original. What the leaders' links don't unite is looked at again: texts of one
bucket that are in different components are compared in blocks, until they are in one component or all such pairs are
done. Left out are only pairs that can't be alike: by their total weights, or because even if all weight that their
shingles have in each of 128 ranges of hashes were shared, they would stay below the threshold. Texts of a bucket's
largest component aren't compared with each other, so a bucket of copies costs few comparisons each. No class that a
band proposes is split, and no pairs are emitted but those that are linked.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT, U64, Batch, Lanes, Prefix, batched, chunks, counted, distinct, kept, mix, pack, parts, send, settled, table, totals, unpack
from .earlier import Units
from .graph import components, salted

BANDS, ROWS, WORDS, LIKE = 12, 4, 5, 0.8
BLOCK = 250  #: texts of a bucket that meet at once in the second look
BINS = 128  #: ranges of hashes whose weights bound a pair's similarity


def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), and their logarithms, at 65536 even steps: a uniform draw becomes a table look-up."""
    u = (np.arange(65536) + 0.5) / 65536
    lo, hi = np.zeros(65536), np.full(65536, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        under = 1 - np.exp(-mid) * (1 + mid) < u
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
    return lo.astype(np.float32), np.log(lo).astype(np.float32)


GAMMA, LOG_GAMMA = _gamma_tables()
_DRAWS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64)) | U64(1)


def _df_words(b: Batch) -> tuple[np.ndarray, np.ndarray]:
    """The batch's distinct words, and how many of its documents have each."""
    got = []
    for lo, hi in chunks(b.texts):
        u = Units(b.texts[lo:hi], True)
        key = Prefix(u.buf).of(u.s, u.e)
        pair = mix(key + u.text.astype(U64))
        order = np.argsort(pair)
        pair = pair[order]
        got.append(key[order[np.concatenate([[True], pair[1:] != pair[:-1]])[: len(key)]]])
    return np.unique(np.concatenate([*got, np.zeros(0, U64)]), return_counts=True)


def _words(b: Batch) -> np.ndarray:
    """The batch's distinct words alone."""
    got = []
    for lo, hi in chunks(b.texts):
        u = Units(b.texts[lo:hi], True)
        got.append(distinct(Prefix(u.buf).of(u.s, u.e)))
    return distinct(np.concatenate([*got, np.zeros(0, U64)]))


def _ordered(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by text and hash, by one sort of both in a word; only where that can't tell two apart, by two sorts."""
    bits = U64(int(text.max(initial=0)).bit_length())
    key = (text.astype(U64) << (U64(63) - bits)) | (h >> (bits + U64(1)))
    order = np.argsort(key)
    key, h = key[order], h[order]
    return np.lexsort((h[np.argsort(order)], text)) if ((np.diff(key) == 0) & (np.diff(h) != 0)).any() else order


def _shingles(b: Batch, right: dict, docs: float, nb: int, want: np.ndarray | None = None):
    """For each part: numbers of its texts, then text, hash and weight of each text's distinct shingles, in this order.

    want: numbers of the only texts asked for."""
    words = _words(b)
    idf = np.log((1 + docs) / (1 + totals(words, nb, right))) + 1
    want = np.arange(len(b.texts)) if want is None else want
    texts = [b.texts[i] for i in want.tolist()]
    for lo, hi in chunks(texts):
        u = Units(texts[lo:hi], True)
        p = Prefix(u.buf)
        own, inv = np.unique(p.of(u.s, u.e), return_inverse=True)
        w = idf[np.searchsorted(words, own)][inv]
        n = np.diff(u.first)
        size = np.minimum(n, WORDS)
        count = np.where(n > 0, n - size + 1, 0)
        text = np.repeat(np.arange(hi - lo), count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + u.first[text]
        end = at + size[text]
        total = np.concatenate([[0], np.cumsum(w)])
        h, w = p.of(u.s[at], u.e[end - 1]), (total[end] - total[at]) / size[text]
        order = _ordered(text, h)
        text, h, w = text[order], h[order], w[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(h) != 0)])[: len(h)])
        tf = np.diff(np.concatenate([new, [len(h)]]))
        yield want[lo:hi], text[new], h[new], np.float32(tf * w[new].round(4))


def _samples(text: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """(n, BANDS * ROWS) samples: improved consistent weighted sampling keeps the shingle and its level of least rank.

    The three random numbers of a shingle and a draw are 16 bits each of the product of its hash and the draw's number."""
    out = np.zeros((n, BANDS * ROWS), U64)
    have, first = np.unique(text, return_index=True)
    if not len(have):
        return out
    size = np.diff(np.concatenate([first, [len(h)]]))
    lw = np.log(w.astype(np.float64)).astype(np.float32)
    own = np.repeat(np.arange(len(have)), size)
    for k, draw in enumerate(_DRAWS):
        x = h * draw
        r = GAMMA.take((x >> U64(48)).view(np.int64), mode="clip")
        low = (x >> U64(16)).astype(np.uint32)
        rank = LOG_GAMMA.take((low >> np.uint32(16)).astype(np.int64), mode="clip")
        beta = (low & np.uint32(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
        t = lw / r
        t += beta
        np.floor(t, out=t)
        beta -= t
        beta -= np.float32(1)
        beta *= r
        rank += beta
        hit = np.flatnonzero(rank == np.minimum.reduceat(rank, first)[own])
        _, once = np.unique(own[hit], return_index=True)
        hit = hit[once]
        out[have, k] = mix(h[hit] + t[hit].astype(np.int64).astype(U64))
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    least = np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64)
    return float(least / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - least))


def binned(text: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's total weight, and the share of it in each range of hashes, rounded up to 65535ths."""
    got = np.bincount(text * BINS + (h >> U64(57)).astype(np.int64), w, n * BINS).reshape(n, BINS)
    total = got.sum(1)
    return total, np.ceil(got / np.maximum(total, 1e-30)[:, None] * 65535).astype(np.uint16)


def bound(weight: np.ndarray, bins: np.ndarray, i: int, js: np.ndarray) -> np.ndarray:
    """What the similarity of text i and each of the others is at most."""
    most = np.minimum(bins[js] * (weight[js] / 65535)[:, None], bins[i] * (weight[i] / 65535)).sum(1)
    most = np.minimum(most, np.minimum(weight[js], weight[i]))
    return most / (weight[js] + weight[i] - most)


def near_duplicates(docs: DataFrame, like: float = LIKE) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), first (whether it is its class's document
    of least id), same (the first 16 bytes of its text's SHA-256; with doc_id, it says which rows are meant).

    Null texts are empty; texts without words match only equal texts. Equal rows share everything but are one document,
    so each of them is `first` where one is. A null doc_id comes after all others."""
    d, n = batched(docs)
    d = settled(d)  # several steps read the batches
    lanes = Lanes.of(n, parts(docs, 3_000_000, 48))
    nb = lanes.first
    many = docs.count()

    def tell(group: pa.Table) -> pa.Table:
        b = Batch(group)
        keys, c = _df_words(b)
        return send(b.number, keys, nb, c)

    back = settled(counted(d.groupBy("batch").applyInArrow(tell, SENT), lanes, hold=True).repartition(n, "batch"))

    def sketched(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Batch(left)
        bands, weight, bins = [], [], []
        for own, text, h, w in _shingles(b, right, many, nb):
            s = _samples(text, h, w, len(own))
            got = np.zeros((len(own), BANDS), U64)
            for i in range(BANDS):
                x = np.full(len(own), i, U64)
                for j in range(ROWS):
                    x = mix(x * U64(31) + s[:, i * ROWS + j])
                got[:, i] = x
            total, share = binned(text, h, w, len(own))
            weight += total.tolist()
            bins += [x.tobytes() for x in share]
            some = np.zeros(len(own), bool)
            some[text] = True
            bands += [x if y else [] for x, y in zip(got.view(np.int64).tolist(), some.tolist(), strict=True)]
        t = table("k long, doc long, same binary, weight double, bins binary", k=b.node, doc=b.doc, same=[hashlib.sha256(x).digest()[:16] for x in b.texts], weight=weight, bins=bins)
        return t.append_column("bands", pa.array(bands, pa.list_(pa.int64())))

    sketch = kept(d.groupBy("batch").cogroup(back.groupBy("batch")).applyInArrow(sketched, "k long, doc long, same binary, weight double, bins binary, bands array<long>"))
    own = sketch.groupBy("same").agg(F.min(F.struct("doc", "k")).alias("x"), *(F.first(c).alias(c) for c in ("bands", "weight", "bins")))
    texts = kept(own.select("same", "x.doc", "x.k", "bands", "weight", "bins"))
    rows = texts.select("k", F.explode("bands").alias("band"))
    rows = kept(salted(rows, rows.groupBy("band").agg(F.count("k").alias("n")).where("n > 1"), ["band"], F.col("k")))
    met = rows.groupBy("k").agg(F.sum("n").alias("met"))
    rows = rows.join(met, "k")
    led = rows.groupBy("band").agg(F.max(F.struct("met", "k")).alias("lead")).select("band", F.col("lead.k").alias("lead"))
    pairs = kept(salted(rows, led, ["band"], F.col("k")).where("k != lead").select(F.col("lead").alias("a"), F.col("k").alias("b")).distinct())

    def features(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = {k for ks in right.column("ks").to_pylist() if ks for k in ks}
        if not asked or not left.num_rows:
            return table("k long, blob binary", k=[], blob=[])
        b, right = Batch(left), right.filter(pa.compute.is_valid(right.column("blob")))
        first = {k: i for i, k in reversed(list(enumerate(b.node.tolist()))) if k in asked}
        ks, blobs = [], []
        for own, text, h, w in _shingles(b, right, many, nb, np.array(sorted(first.values()), np.int64)):
            cut = np.searchsorted(text, np.arange(len(own) + 1))
            for i, k in enumerate(b.node[own].tolist()):
                ks.append(k)
                blobs.append(pack((h[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]])))
        return table("k long, blob binary", k=ks, blob=blobs)

    def shingles(asked: DataFrame) -> DataFrame:
        """(k, blob of hashes and weights) of each k asked for."""
        asked = asked.distinct().select(F.shiftright("k", 32).cast("int").alias("batch"), "k")
        asked = asked.groupBy("batch").agg(F.collect_list("k").alias("ks"))  # at most a batch's documents
        right = back.withColumn("ks", F.lit(None).cast("array<long>")).unionByName(asked, allowMissingColumns=True)
        return kept(d.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(features, "k long, blob binary"))

    have = shingles(pairs.select(F.explode(F.array("a", "b")).alias("k")))

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, like) of each pair."""
        # a leader's pairs go to as many groups as they need; each gets the leader's shingles once
        sizes = pairs.groupBy("a").agg(F.ceil(F.count("b") / 64).cast("int").alias("n"))
        leads = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
        left = leads.join(have.select(F.col("k").alias("a"), "blob"), "a").select(F.col("a").alias("lead"), F.col("salt").alias("part"), F.col("blob").alias("shingles"))
        spread = salted(pairs, sizes, ["a"], F.col("b")).select("a", "b", F.pmod(F.xxhash64("b"), F.col("n")).cast("int").alias("salt"))
        right = spread.join(have.select(F.col("k").alias("b"), "blob"), "b")

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return table("a long, b long, alike double", a=[], b=[], alike=[])
            lead = unpack(left.column("shingles")[0].as_py())
            got = [similarity(lead, unpack(x)) for x in right.column("blob").to_pylist()]
            return table("a long, b long, alike double", a=right.column("a").to_pylist(), b=right.column("b").to_pylist(), alike=got)

        return left.groupBy("lead", "part").cogroup(right.groupBy("a", "salt")).applyInArrow(compare, "a long, b long, alike double")

    links = kept(verified(pairs).where(F.col("alike") >= like - 1e-9).select("a", "b"))
    # a second look at buckets that hold several components
    root = components(links)
    own = texts.select("k", F.posexplode("bands").alias("i", "band")).join(root.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    split = own.groupBy("band", "root").agg(F.count("k").alias("n")).groupBy("band").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    split = split.where("n > top.n").select("band", F.col("top.root").alias("top"), blocks(F.col("top.n")).alias("p"), blocks(F.col("n") - F.col("top.n")).alias("q"))
    # the largest component's texts lie in the first p blocks and meet the q blocks of the others, which meet all
    minor, number = F.col("root") != F.col("top"), F.xxhash64("k")
    part = salted(own, split, ["band"], F.col("k")).join(texts.select("k", "bands", "weight", "bins"), "k")
    part = part.withColumn("block", F.when(minor, F.col("p") + F.pmod(number, F.col("q"))).otherwise(F.pmod(number, F.col("p"))).cast("int"))
    part = part.withColumn("other", F.explode(F.sequence(F.when(minor, 0).otherwise(F.col("p")), F.col("p") + F.col("q") - 1)))
    part = part.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    look = "k long, root long, weight double, bins binary, i int, band long, bands array<long>, block int, lo int, hi int"
    part = part.select(*(x.split()[0] for x in look.split(", ")))

    def pairing(group: pa.Table):
        """For each text but the last: the later ones worth a comparison that no earlier band and no other block pair makes."""
        bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), np.uint16).reshape(group.num_rows, -1)
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        at, root, block, weight = (group.column(c).to_numpy() for c in ("i", "root", "block", "weight"))
        cross = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        for i in range(group.num_rows - 1):
            ok = root[i + 1 :] != root[i]
            if cross:
                ok &= block[i + 1 :] != block[i]
            ok &= ~(bands[i + 1 :, : at[i]] == bands[i, : at[i]]).any(1)
            ok &= np.minimum(weight[i + 1 :], weight[i]) >= (like - 1e-6) * np.maximum(weight[i + 1 :], weight[i])
            js = i + 1 + np.flatnonzero(ok)
            js = js[bound(weight, bins, i, js) >= like - 1e-6]
            if len(js):
                yield i, js

    def worth(group: pa.Table) -> pa.Table:
        use = np.zeros(group.num_rows, bool)
        for i, js in pairing(group):
            use[i] = True
            use[js] = True
        return group.select([x.split()[0] for x in look.split(", ")]).filter(pa.array(use))

    def united(group: pa.Table) -> pa.Table:
        """Links that unite components; a pair whose components are already one is left out."""
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        k, root = group.column("k").to_pylist(), group.column("root").to_pylist()
        blobs = group.column("blob").to_pylist()
        had: dict[int, tuple] = {}
        a, b = [], []
        for i, js in pairing(group):
            for j in js.tolist():
                if find(root[i]) != find(root[j]):
                    x, y = (had[t] if t in had else had.setdefault(t, unpack(blobs[t])) for t in (i, j))
                    if similarity(x, y) >= like - 1e-9:
                        up[find(root[i])] = find(root[j])
                        a.append(k[i])
                        b.append(k[j])
        return table("a long, b long", a=a, b=b)

    again = kept(part.groupBy("band", "lo", "hi").applyInArrow(worth, look))
    if not again.isEmpty():
        # whatever shares a bucket with another text met its leader, or is it: its shingles are at hand
        more = again.join(have, "k").groupBy("band", "lo", "hi").applyInArrow(united, "a long, b long")
        links = kept(links.union(more).distinct())
        root = components(links)
    named = texts.select("same", "doc", "k").join(root.withColumnRenamed("node", "k"), "k", "left")
    named = kept(named.select("same", "doc", "k", F.coalesce("root", "k").alias("root")))
    least = named.groupBy("root").agg(F.min(F.struct("doc", "k")).alias("least"))
    named = kept(salted(named, least, ["root"], F.col("k")).select("same", "least"))
    real = lambda c: F.when(F.col(c) != int(np.iinfo(np.int64).max), F.col(c))
    return sketch.select("k", "doc", "same").join(named, "same").select(
        real("doc").alias("doc_id"), real("least.doc").alias("class_id"), (F.struct("doc", "k") == F.col("least")).alias("first"), "same"
    )
