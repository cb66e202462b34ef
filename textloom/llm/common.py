"""What several operators share: batches of documents, numpy kernels on UTF-8 bytes, and an exact distributed count.

A *batch* is the set of documents whose key hashes to one number. The number of batches follows the input's size, so
a batch stays small whatever the input. Documents are dealt to batches once; a plan that needs them again reuses that
exchange. What a batch sends to others is packed per bucket, so few rows cross the JVM and every key leaves a batch
at most once, however often it occurs there: a key that fills a third of the corpus costs one entry per batch.
"""

from __future__ import annotations

import ctypes
import gc
import pickle
import tempfile
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from xxhash import xxh3_64_intdigest
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAST = np.iinfo(np.int64).max  #: the order key of a null doc_id: after all others
U64 = np.uint64
SPACES = bytes([9, 10, 11, 12, 13, 32])


def pack(obj) -> bytes:
    return zstandard.compress(pickle.dumps(obj, protocol=5), 1)


def unpack(blob: bytes):
    return pickle.loads(zstandard.decompress(blob))


_PLAIN = ("Project", "Filter", "LogicalRelation", "LocalRelation", "DataSourceV2ScanRelation", "DataSourceV2Relation", "SubqueryAlias")


def plan_bytes(df: DataFrame) -> int:
    """The bytes of the files that df reads, if it does no more than read them; no job runs then. Of any other plan
    Catalyst's guess may be far off, so its texts are summed, and halved, since files are packed."""
    plan = df._jdf.queryExecution().optimizedPlan()
    node = plan
    while node.nodeName() in _PLAIN and node.children().size() == 1:
        node = node.children().apply(0)
    if node.nodeName() in _PLAIN and node.children().isEmpty() and (n := int(str(node.stats().sizeInBytes()))) < 1 << 60:
        return n
    texts = [c for c, kind in df.dtypes if kind in ("string", "binary")]
    total = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(16)).cast("long")
    return int(df.agg(F.sum(total)).first()[0] or 0) // 2


def parts(df: DataFrame, each: int, least: int = 24) -> int:
    """How many groups of about `each` input bytes."""
    return max(least, plan_bytes(df) // each + 1)


def row_key(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


class Batch:
    """A batch's documents ordered by k (a hash of id and text), id and text: equal rows follow each other and share every result.

    doc is the id as an order key, id the id itself, texts are UTF-8 bytes, more holds the further columns asked for.
    node numbers the different rows: the batch in the upper half, the row's place among them in the lower."""

    def __init__(self, group: pa.Table):
        trim()
        self.number = int(group.column("batch")[0].as_py())
        got = [unpack(x) for x in group.column("blob").to_pylist()]
        k = np.concatenate([x[0] for x in got])
        doc = np.concatenate([x[1] for x in got])
        texts, more = [t for x in got for t in x[2]], [[v for x in got for v in x[3][c]] for c in range(len(got[0][3]))]
        order = np.lexsort((doc, k))
        for i, j in zip(*runs(np.diff(k[order]) == 0), strict=True):  # rows of one hash, mostly equal ones
            order[i : j + 1] = sorted(order[i : j + 1].tolist(), key=lambda r: (doc[r], texts[r]))
        self.k, self.doc = k[order], doc[order]
        self.texts = [texts[i] for i in order]
        self.more = [[m[i] for i in order] for m in more]
        self.id = [None if x == LAST else x for x in self.doc.tolist()]
        new = np.concatenate([[True], (np.diff(self.k) != 0) | (np.diff(self.doc) != 0)])[: len(k)]
        for i in np.flatnonzero(~new).tolist():
            new[i] = self.texts[i] != self.texts[i - 1]
        self.node = (self.number << 32) + np.cumsum(new)


def _packed(batches: Iterator[pa.RecordBatch], extra: list[str], most: int = 48_000_000) -> Iterator[pa.RecordBatch]:
    """A row for each batch among about `most` bytes of input. Rows are put in order once: each batch's are cut out of
    it, as to take them from the whole would copy it once for each batch."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        t = pa.Table.from_batches(held)
        b = t.column("batch").to_numpy()
        order = np.argsort(b, kind="stable")
        b, k, doc = b[order], t.column("k").to_numpy()[order], t.column("doc").to_numpy()[order]
        texts, *others = ([x[i] for i in order.tolist()] for x in (binary(t.column("text")), *(t.column(c).to_pylist() for c in extra)))
        cut = np.flatnonzero(np.diff(b, prepend=-1)).tolist()
        for i, j in zip(cut, [*cut[1:], len(b)], strict=True):
            blob = pack((k[i:j], doc[i:j], texts[i:j], [x[i:j] for x in others]))
            yield pa.RecordBatch.from_pydict({"batch": pa.array([b[i]], pa.int32()), "blob": pa.array([blob], pa.binary())})

    for rb in batches:
        held.append(rb)
        size += rb.nbytes
        if size > most:
            yield from flush()
            held, size = [], 0
    if sum(len(x) for x in held):
        yield from flush()


def batched(docs: DataFrame, *more: Column, each: int = 4_000_000) -> tuple[DataFrame, int]:
    """(batch, blob): the rows with null texts empty and null ids last, dealt to batches by id and text, packed."""
    n = parts(docs, each)
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    got = docs.select(
        F.pmod(key, F.lit(n)).cast("int").alias("batch"), key.alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(c.alias(f"more{i}") for i, c in enumerate(more)),
    )

    extra = [f"more{i}" for i in range(len(more))]

    return got.mapInArrow(lambda it: _packed(it, extra), "batch int, blob binary").repartition(n, "batch"), n


# ---------------------------------------------------------------- bytes, words, hashes

_POW: dict[str, np.ndarray] = {}
_Q = 0x9E3779B97F4A7C15 | 1
_QINV = pow(_Q, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("q", ())) < n:
        n = max(n, 1 << 20)
        for name, base in (("q", _Q), ("inv", _QINV)):
            a = np.ones(n, U64)
            done = 1
            while done < n:
                step = min(done, n - done)
                a[done : done + step] = a[:step] * U64(pow(base, done, 1 << 64))
                done += step
            _POW[name] = a
    return _POW["q"], _POW["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xC2B2AE3D27D4EB4F)
    x ^= x >> U64(32)
    return x


class Prefix:
    """Prefix sums from which the 64-bit hash of any substring follows in constant time."""

    def __init__(self, buf: np.ndarray, salt: int = 1):
        q, self.inv = _powers(len(buf) + 1)
        self.p = np.zeros(len(buf) + 1, U64)
        v = buf.astype(U64)
        if salt == 1:
            v += U64(1)
        else:
            v = (v + U64(salt)) * U64(0xFF51AFD7ED558CCD)
            v ^= v >> U64(17)
        v *= q[: len(buf)]
        np.cumsum(v, out=self.p[1:])

    def of(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.p[e] - self.p[s]) * self.inv[s])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one blank after each, as bytes, and each text's start."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=start[1:])
    return buf, start


_SPACE = np.ones(256, bool)
_SPACE[list(SPACES)] = False


def words(buf: np.ndarray, table: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that the table accepts. The last byte is a blank."""
    d = np.diff(np.concatenate([[False], table[buf]]).astype(np.int8))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def coded(buf: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray = _SPACE) -> tuple[np.ndarray, pa.Array]:
    """The number of each word, and the words themselves by number: words that share a number are the same bytes."""
    at = np.zeros(len(s) + 1, np.int32)
    np.cumsum(e - s, out=at[1:])
    packed = np.ascontiguousarray(buf[table[buf]])
    got = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(at), pa.py_buffer(packed)]).dictionary_encode()
    return got.indices.to_numpy(), got.dictionary


def keyed(some: pa.Array) -> np.ndarray:
    """A 64-bit key of each word: XXH3 of its bytes, of which no regular text makes collisions, unlike of a polynomial."""
    return np.fromiter(map(xxh3_64_intdigest, some.to_pylist()), U64, len(some))


def chunks(texts: list[bytes], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text stands alone."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])[: len(x)]]


def binary(column) -> list[bytes]:
    if isinstance(column, pa.ChunkedArray):
        return [x for c in column.chunks for x in binary(c)]
    return column.cast(pa.large_binary()).to_pylist() if pa.types.is_large_string(column.type) else column.cast(pa.binary()).to_pylist()


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true flags."""
    d = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


try:
    _give_back = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _give_back = lambda _: None


def trim() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, and would keep the most it ever had."""
    pa.default_memory_pool().release_unused()
    _give_back(0)


def table(schema: str, **columns) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    out = pa.table({n: pa.array(columns[n], kinds[k]) for n, k in (x.split() for x in schema.split(", "))})
    columns.clear()
    trim()
    return out


# ---------------------------------------------------------------- from batches to buckets and back

SENT = "bucket int, batch int, blob binary"
FAN = 2000  #: rows that a batch sends, and that a bucket gets, at most
ROWS = 100_000  #: rows that all batches send all buckets at most in one hop: beyond, rows cost more than another hop


@dataclass(frozen=True)
class Lanes:
    """The way from many senders to many receivers.

    A row for each pair of them would grow with the square of the input. So where either are more than FAN, or their
    pairs more than ROWS, rows travel in hops: a hop parts the receivers' numbers into `wide` times as many lanes, and
    joins what `fan` neighbouring senders have for one lane. A sender's rows are bounded by `wide` then, and their number
    grows with the input. `fan` is about `wide`, so what a hop joins is about as much as one sender sends."""

    wide: int
    hops: int
    fan: int

    @classmethod
    def of(cls, senders: int, receivers: int, fan: int | None = None) -> Lanes:
        fan = fan or FAN
        if max(senders, receivers) <= fan and senders * receivers <= ROWS:
            return cls(receivers, 1, fan)
        hops = next(h for h in range(2, 64) if fan**h >= max(senders, receivers))
        least = lambda n: next(w for w in range(2, fan + 1) if w**hops >= n)
        wide = least(receivers)
        return cls(wide, hops, max(wide, least(senders)))

    def count(self, hop: int) -> int:
        """Lanes after so many hops; after the last one each is a receiver."""
        return self.wide**hop

    @property
    def first(self) -> int:
        return self.count(1)


def post(sender: int, items: dict[int, object], lanes: Lanes, hop: int = 1) -> pa.Table:
    """What a sender has for each receiver, a row for each lane. Receivers below 0 get it at once."""
    step, rows = lanes.count(lanes.hops - hop), defaultdict(list)
    for to, x in items.items():
        rows[to if to < 0 else to // step].append((to, sender, x))
    return table(SENT, bucket=list(rows), batch=[sender] * len(rows), blob=[pack(x) for x in rows.values()])


def _regrouping(step: int) -> Callable[[pa.Table], pa.Table]:
    def regroup(group: pa.Table) -> pa.Table:
        rows = defaultdict(list)
        for blob in group.column("blob").to_pylist():
            for x in unpack(blob):
                rows[x[0] if x[0] < 0 else x[0] // step].append(x)
        node = group.column("node")[0].as_py()
        return table(SENT, bucket=list(rows), batch=[node] * len(rows), blob=[pack(x) for x in rows.values()])

    return regroup


def relayed(posted: DataFrame, lanes: Lanes) -> DataFrame:
    """The same by receiver: rows of (bucket: receiver, batch, blob: (receiver, sender, item)s)."""
    for hop in range(2, lanes.hops + 1):
        posted = posted.withColumn("node", F.floor(F.col("batch") / lanes.fan).cast("int")).groupBy("bucket", "node").applyInArrow(_regrouping(lanes.count(lanes.hops - hop)), SENT)
    return posted


def _ranges(keys: np.ndarray, nb: int) -> np.ndarray:
    """Where each bucket's part of the sorted keys begins: buckets are equal ranges of the 64-bit hashes."""
    return np.searchsorted(((keys >> U64(32)) * U64(nb) >> U64(32)).astype(np.int64), np.arange(nb + 1))


def pack_ints(x: np.ndarray) -> tuple:
    """Whole numbers from 0, byte by byte: each place of a byte packs away by itself, and places without a byte cost nothing."""
    size = next(n for n in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << (8 * n))
    planes = np.ascontiguousarray(x.astype(f"<u{size}").reshape(-1, 1).view(np.uint8).T)
    return x.shape, [zstandard.compress(p.tobytes(), 1) for p in planes]


def unpack_ints(packed: tuple, kind=np.int64) -> np.ndarray:
    shape, planes = packed
    bytes_ = np.stack([np.frombuffer(zstandard.decompress(p), np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(bytes_).view(f"<u{len(planes)}").reshape(shape).astype(kind)


def pack_keys(keys: np.ndarray) -> tuple:
    """Sorted keys as differences, whose high bytes are nearly all zero."""
    return pack_ints(np.diff(keys, prepend=U64(0)))


def unpack_keys(packed: tuple) -> np.ndarray:
    return np.cumsum(unpack_ints(packed, U64), dtype=U64)


def send(batch: int, keys: np.ndarray, nb: int, *counts: np.ndarray) -> pa.Table:
    """One row per bucket that has keys; keys are distinct and sorted, each with one count or several."""
    cut = _ranges(keys, nb)
    full = np.flatnonzero(np.diff(cut))
    n = np.stack(counts)
    return table(SENT, bucket=full, batch=np.full(len(full), batch), blob=[pickle.dumps((pack_keys(keys[cut[b] : cut[b + 1]]), pack_ints(n[:, cut[b] : cut[b + 1]]))) for b in full])


def _summed(blobs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of some senders, their totals, each entry's place among them, and each sender's first entry."""
    keys = np.concatenate([unpack_keys(b[0]) for b in blobs])
    n = np.concatenate([unpack_ints(b[1]) for b in blobs], axis=1)
    uniq, inv = np.unique(keys, return_inverse=True)
    return uniq, np.stack([np.bincount(inv, x, len(uniq)).astype(np.int64) for x in n]), inv, np.cumsum([0] + [b[1][0][1] for b in blobs])


def _shared(group: pa.Table, total: np.ndarray, inv: np.ndarray, cut: np.ndarray) -> dict[str, list]:
    got = total[:, inv]
    return {"bucket": group.column("bucket").to_pylist(), "batch": group.column("batch").to_pylist(), "blob": [pickle.dumps(pack_ints(got[:, i:j])) for i, j in zip(cut, cut[1:], strict=False)]}


def counted(sent: DataFrame, lanes: Lanes, about: Callable[..., object] | None = None, hop: int = 1, hold: bool = False) -> DataFrame:
    """Totals of each key over all batches: (bucket, batch, blob of totals in the order sent).

    With `about`, a bucket adds a row of batch -1 that holds about(distinct keys, *totals).

    Entries of one key come once from each sender, so a group is bounded by its distinct keys times the senders that
    have them, and packed sorted runs are summed by one sort. Before the last hop, `fan` senders' sums travel on as one
    sender's, and what comes back is shared out among them. Both steps read what was sent. Spark makes it for each of
    them anew where it comes from settled() rows, as it can't tell there that both are the same: `hold` settles it."""
    if hop == lanes.hops:

        def total(group: pa.Table) -> pa.Table:
            uniq, each, inv, cut = _summed([pickle.loads(b) for b in group.column("blob").to_pylist()])
            out = _shared(group, each, inv, cut)
            if about:
                out = {k: [*x, y] for (k, x), y in zip(out.items(), (out["bucket"][0], -1, pickle.dumps(about(uniq, *each))), strict=True)}
            return table(SENT, **out)

        return sent.groupBy("bucket").applyInArrow(total, SENT)

    def merge(group: pa.Table) -> pa.Table:
        uniq, each, *_ = _summed([pickle.loads(b) for b in group.column("blob").to_pylist()])
        return send(group.column("node")[0].as_py(), uniq, lanes.count(hop + 1), *each)

    def share(left: pa.Table, right: pa.Table) -> pa.Table:
        uniq, each, inv, cut = _summed([pickle.loads(b) for b in left.column("blob").to_pylist()])
        total = totals(uniq, lanes.count(hop + 1), right, len(each))
        return table(SENT, **_shared(left, total.reshape(len(each), -1), inv, cut))

    mine = sent.withColumn("node", F.floor(F.col("batch") / lanes.fan).cast("int")).repartition("bucket", "node")
    mine = settled(mine) if hold else mine
    back = counted(mine.groupBy("bucket", "node").applyInArrow(merge, SENT), lanes, about, hop + 1, hold)
    wider = back.where("batch >= 0").withColumn("lane", F.floor(F.col("bucket") / lanes.wide).cast("int"))
    out = mine.groupBy("bucket", "node").cogroup(wider.groupBy("lane", "batch")).applyInArrow(share, SENT)
    return out.union(back.where("batch < 0")) if about else out


def totals(keys: np.ndarray, nb: int, back: pa.Table, counts: int = 1) -> np.ndarray:
    """The totals of a batch's distinct sorted keys, from what counted() sent back to it; of several counts a row each."""
    cut = _ranges(keys, nb)
    out = np.zeros((counts, len(keys)), np.int64)
    for b, blob in zip(back.column("bucket").to_pylist(), back.column("blob").to_pylist(), strict=True):
        out[:, cut[b] : cut[b + 1]] = unpack_ints(pickle.loads(blob))
    return out if counts > 1 else out[0]


def release(df: DataFrame) -> None:
    """Let Spark drop the shuffle files of finished steps now, not when the driver happens to collect its garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def shared_folder(sc: SparkContext) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of our own, but only if driver and executors share a machine."""
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="checkpoint-")


def kept(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(sc))
    out = df.checkpoint(eager)
    if eager:
        release(out)
    return out


def settled(df: DataFrame) -> DataFrame:
    """kept() of rows that are dealt by a key, so that Spark goes on knowing how: later steps by that key don't shuffle them.

    An adaptive plan forgets its partitioning at a checkpoint; a fixed one doesn't."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    was = conf.get(key)
    conf.set(key, "false")
    try:
        return kept(df)
    finally:
        conf.set(key, was)
