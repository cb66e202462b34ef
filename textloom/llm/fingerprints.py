"""Document fingerprints: a threshold-scaled sketch.

The sketch of a text keeps every hash of its shingles (five words) below a fixed fraction of the hash range. Since the
fraction is the same for all texts, sketches of sets of shingles unite to the sketch of the union, and the share of the
smaller sketch that is in the larger one estimates containment however unequal the texts are.

A text none of whose hashes lies below the threshold has a *mark* instead: its least hash, told apart by its size. A
mark says only whether two such texts are equal; where sketches unite it goes as soon as there is a kept hash, so the
union's sketch stays exact. With one hash in four kept, a text of 20 words has a mark with probability 0.01, and from
there on containment is estimated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST, U64, Prefix, chunks, parts, table
from .earlier import Units

WORDS = 5
FRACTION = 4  #: one in so many hashes is kept
SHIFT = U64(30)  #: kept hashes have 32 bits after this shift, a mark has more


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The kept hashes of each text, sorted; or its mark."""
    raw, out = [t.encode() for t in texts], []
    for lo, hi in chunks(raw):
        u = Units(raw[lo:hi], True)
        n = np.diff(u.first)
        size = np.minimum(n, WORDS)
        count = np.where(n > 0, n - size + 1, 0)
        text = np.repeat(np.arange(hi - lo), count)
        at = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + u.first[text]
        h = Prefix(u.buf).of(u.s[at], u.e[at + size[text] - 1]) >> SHIFT
        first = (np.cumsum(count) - count)[count > 0]
        least = np.zeros(hi - lo, U64)
        if len(first):
            least[count > 0] = np.minimum.reduceat(h, first)
        keep = (h < U64((1 << 64) // FRACTION >> int(SHIFT))) | (h == least[text])
        text, h = text[keep], h[keep]
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        new = np.concatenate([[True], (np.diff(text) != 0) | (np.diff(h) != 0)])[: len(h)]
        text, h = text[new], h[new]
        cut = np.searchsorted(text, np.arange(hi - lo + 1))
        out += [h[i:j] for i, j in zip(cut, cut[1:], strict=False)]
    return out


def marked(sketch: np.ndarray) -> bool:
    return len(sketch) == 1 and int(sketch[0]) >> 32 > 0


def written(sketch: np.ndarray) -> str:
    """Eight hexadecimal digits a hash; a mark is longer and begins with `~`."""
    return f"~{int(sketch[0]):09x}" if marked(sketch) else sketch.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    if fingerprint.startswith("~"):
        return np.array([int(fingerprint[1:], 16)], U64)
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(U64)


def merge(a: str, b: str) -> str:
    """The fingerprint of the shingles of both."""
    x, y = read(a), read(b)
    every = np.union1d(x, y)
    if marked(x) or marked(y):
        kept = every[every >> U64(32) == 0]
        every = kept if len(kept) else every[:1]
    return written(every)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller sketch in the larger. Two empty ones are alike, one empty one is like nothing; a mark is
    like an equal mark and nothing else."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str]) -> pa.Table:
    """One row for each text but the last, which is only the next one of the one before."""
    edited = []
    for t, after in zip(texts, texts[1:], strict=False):
        half = len(t) // 2
        edited.append(t[: len(t) - half] + after[:half])
    own, other = sketches(texts), sketches(edited)
    return table(
        OUT, doc_id=[None if i == LAST else i for i in ids[:-1]], n_chars=[len(t) for t in texts[:-1]], edited_sha256=[hashlib.sha256(t.encode()).hexdigest() for t in edited],
        fingerprint=[written(x) for x in own[:-1]], edited_fingerprint=[written(x) for x in other],
        near_edited=[likeness(a, b) for a, b in zip(own, other, strict=False)], near_next=[likeness(a, b) for a, b in zip(own, own[1:], strict=False)],
    )


SAMPLED = 40  #: keys a range, from which the ranges' bounds are taken


def _bounds(keys: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first keys of n - 1 even ranges, from a sample drawn by the keys' hashes: however often the plan runs, rows fall alike."""
    rows = keys.count()
    one_in = max(1, rows // (n * SAMPLED))
    some = keys.where(F.pmod(F.xxhash64(F.lit(5), "doc", "tie"), F.lit(one_in)) == 0).orderBy("doc", "tie").toArrow()  # about SAMPLED a range
    doc, tie = some.column("doc").to_numpy(), some.column("tie").to_numpy()
    at = np.unique(np.arange(1, n) * len(doc) // n) if len(doc) else np.zeros(0, np.int64)
    return doc[at], tie[at]


def _find(doc: np.ndarray, tie: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bounds are at or below each key."""
    lo, hi = np.searchsorted(bounds[0], doc, "left"), np.searchsorted(bounds[0], doc, "right")
    for i in np.flatnonzero(lo < hi):  # the key's id is a bound's
        lo[i] += np.searchsorted(bounds[1][lo[i] : hi[i]], tie[i], "right")
    return lo


def fingerprint(docs: DataFrame, each: int = 8_000_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is the next document's beginning.

    The next document is the next in ascending doc_id, after the last the first; a null doc_id comes last, rows that
    share a doc_id go by a hash of their text, equal rows follow each other. Null texts are empty: their fingerprint is
    the empty string. An empty table gives no rows; a single document is its own next.

    Rows are dealt by fixed bounds in ranges of about `each` bytes and streamed in order. A range's first and last text
    meet those of its neighbours, two texts a group."""
    n = parts(docs, each, 12)
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"), F.xxhash64("text").alias("tie")]
    bounds = _bounds(docs.select(*key), n)

    @F.arrow_udf("int")
    def ranged(doc: pa.Array, tie: pa.Array) -> pa.Array:
        return pa.array(_find(doc.to_numpy(zero_copy_only=False), tie.to_numpy(zero_copy_only=False), bounds), pa.int32())

    x = docs.select(*key, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    x = x.select(ranged("doc", "tie").alias("range"), "doc", "tie", "text").repartitionById(n, F.col("range")).sortWithinPartitions("range", "doc", "tie")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list]]:
        """Range, ids and texts of at most 500 neighbours of one range."""
        for rb in batches:
            of = rb.column("range").to_numpy()
            cut = sorted({*range(0, rb.num_rows, 500), *(np.flatnonzero(np.diff(of)) + 1).tolist(), rb.num_rows})
            for i, j in zip(cut, cut[1:], strict=False):
                yield int(of[i]), rb.column("doc")[i:j].to_pylist(), rb.column("text")[i:j].to_pylist()

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, [], [])
        for r, ids, texts in split(batches):
            if r == held[0]:
                ids, texts = held[1] + ids, held[2] + texts
            held = (r, ids[-1:], texts[-1:])
            if len(ids) > 1:
                yield from _compared(ids, texts).to_batches()

    edge = "range int, side int, doc long, text string"

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        say = lambda r, side, doc, text: table(edge, range=[r], side=[side], doc=[doc], text=[text]).to_batches()
        for r, ids, texts in split(batches):
            if last is None or last[0] != r:
                if last:
                    yield from say(last[0], 1, *last[1:])
                yield from say(r, 0, ids[0], texts[0])
            last = (r, ids[-1], texts[-1])
        if last:
            yield from say(last[0], 1, *last[1:])

    def joint(group: pa.Table) -> pa.Table:
        t = group.sort_by([("side", "descending")])  # the one range's last, the next one's first
        return _compared(t.column("doc").to_pylist(), t.column("text").to_pylist())

    ends = x.mapInArrow(edges, edge)
    full = docs.select(ranged(*key).alias("range")).distinct()  # a number for each range that has rows
    before = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy()))
    full = full.select("range", before.alias("before"))
    ends = ends.join(full, "range").withColumn("joint", F.when(F.col("side") == 1, F.col("range")).otherwise(F.col("before")))
    return x.mapInArrow(inner, OUT).union(ends.groupBy("joint").applyInArrow(joint, OUT))
