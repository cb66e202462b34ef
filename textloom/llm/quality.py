"""Quality classifier by co-training.

Two classifiers see different sides of a document: one its text (its style, and words that mark bad documents), one its
metadata (language, source, length). Both start from labelled documents. Over some rounds each labels unlabelled
documents, and those of which it is surest, by its calibrated probability, join the other's training data at half
weight. In the end both are calibrated on labelled documents that neither was trained on, and a third small model on
the same documents weighs the two calibrated views against each other. That score decides on all documents.

A document is good if its quality is 1 and it isn't toxic. The labelled documents are a bounded sample: at most
LABELLED, those with the least hashes of their ids, so reruns agree. The unlabelled ones are all others. Their features
are computed once, one row for each bag of words, and stay distributed: a round sums their gradients and curvatures for
the text classifier and counts their pseudo-labels by metadata for the other, so the driver gets sums alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Prefix, binary, chunks, distinct, joined, kept, mix, pack, parts, trim, unpack, words
from .contamination import _WORD, FOLD

LABELLED = 8000
ROUNDS, SURE = 4, 0.97
STYLE = 16
SEEN, LENGTHS = 10, 24  #: labelled documents that a language or source needs for a column of its own; columns of lengths
_KINDS = np.zeros((5, 256), bool)
_KINDS[0, 0x41:0x5B] = True  # capitals
_KINDS[1, 0x30:0x3A] = True  # digits
_KINDS[2, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True  # signs
_KINDS[3, [ord(c) for c in ".,"]] = True
_KINDS[4, 0x80:] = True


def style(texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A row of numbers that describe each text's form, and its words (letters and digits, lower case)."""
    rows, sets = [], []
    for lo, hi in chunks(texts):
        buf, start = joined(texts[lo:hi])
        n = hi - lo
        size = np.maximum(np.diff(start) - 1, 0)
        per = lambda flags: np.add.reduceat(flags.astype(np.int64), start[:-1])  # noqa: E731, B023
        s, e = words(buf)
        first = np.searchsorted(s, start)
        count = np.diff(first)
        text = np.repeat(np.arange(n), count)
        one = np.maximum(count, 1)
        key = Prefix(buf).of(s, e)
        _, at, c = np.unique(mix(key + text.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        of = text[at]
        most = np.zeros(n)
        np.maximum.at(most, of, c)
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (text[1:] == text[:-1])]) if len(key) else np.zeros(0, bool)
        signs = np.concatenate([[0], np.cumsum(_KINDS[2][buf], dtype=np.int32)])
        kinds = [per(t[buf]) / np.maximum(size, 1) for t in _KINDS]
        ends = np.isin(buf[e - 1], np.frombuffer(b".!?", np.uint8)) if len(e) else np.zeros(0, bool)
        caps = np.concatenate([[0], np.cumsum(_KINDS[0][buf], dtype=np.int32)])
        upper = (caps[e] - caps[s]) * 2 > e - s if len(s) else np.zeros(0, bool)
        lines = per(buf == 10)
        by = lambda x: np.bincount(text, x, n) / one  # noqa: E731, B023
        rows.append(np.stack([
            np.log1p(count), size / one / 10, *kinds, np.bincount(of, minlength=n) / one, most / one, by(again), by(signs[e] - signs[s] > 0), by(signs[e] - signs[s] > 1), by(ends), by(upper),
            np.log1p(lines) / 4, count == 0,
        ], axis=1).astype(np.float64))
        folded, begin = joined([t.translate(FOLD) for t in texts[lo:hi]])
        s, e = words(folded, _WORD)
        key = Prefix(folded).of(s, e)
        cut = np.searchsorted(s, begin)
        sets += [key[i:j] for i, j in zip(cut, cut[1:], strict=False)]
    return (np.concatenate(rows) if rows else np.zeros((0, STYLE))), sets


def slices(batches: Iterator[pa.RecordBatch], text: Callable[[pa.RecordBatch], pa.Array] = lambda rb: rb.column("text"), most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Ranges of each batch's rows with about `most` bytes of text, and their texts; a longer text comes with few others.

    What is made of a text takes many times its room, so a worker never holds that of a whole batch."""
    for rb in batches:
        at = np.cumsum(pc.binary_length(text(rb)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) + 1) // most
        cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(rb)]
        for i, j in zip(cut, cut[1:], strict=False):
            if i < j:
                part = rb.slice(i, j - i)
                yield part, [t or b"" for t in binary(text(part))]
                del part
        del rb
        trim()


@dataclass
class Slots:
    """The metadata columns: one for each language and each source that the labelled sample has SEEN times, one for all others
    of either, and the stated length in steps of two."""

    lang: dict
    source: dict

    @classmethod
    def of(cls, lang: list, source: list) -> Slots:
        number = lambda some: {x: i + 1 for i, x in enumerate(sorted((x for x, n in Counter(some).items() if n >= SEEN), key=repr))}
        return cls(number(lang), number(source))

    @property
    def width(self) -> int:
        return len(self.lang) + len(self.source) + 2 + LENGTHS

    def at(self, lang: list, source: list, n_chars: list) -> np.ndarray:
        """The three columns that each document sets."""
        a, b = len(self.lang) + 1, len(self.lang) + len(self.source) + 2
        got = [(self.lang.get(x, 0), a + self.source.get(y, 0), b + min(max(int(c or 0), 0).bit_length(), LENGTHS - 1)) for x, y, c in zip(lang, source, n_chars, strict=True)]
        return np.array(got, np.int64).reshape(-1, 3)


def metadata(at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(at), width))
    out[np.arange(len(at))[:, None], at] = 1
    return out


def slopes(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted log loss."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
    return x.T @ (w * (p - y)), (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1.0, more: Callable | None = None) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method; more(beta) gives the slopes of further rows."""
    beta = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(beta), l2)
    ridge[-1] = 1e-6
    for _ in range(25):
        grad, bend = slopes(x, y, w, beta)
        if more:
            g, h = more(beta)
            grad, bend = grad + g, bend + h
        step = np.linalg.solve(bend + np.diag(ridge), grad + ridge * beta)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def linear(beta: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ beta[:-1] + beta[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def marking(sets: list[np.ndarray], bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that occur in bad documents far beyond chance (likelihood ratio over 30, odds over 7.4), with log odds."""
    keys, inv = np.unique(np.concatenate([*sets, np.zeros(0, U64)]), return_inverse=True)
    of = np.repeat(bad, [len(s) for s in sets])
    a = np.bincount(inv, of, len(keys))
    b = np.bincount(inv, ~of, len(keys))
    na, nb = max(bad.sum(), 1), max((~bad).sum(), 1)
    mean = (a + b) / (na + nb)
    part = lambda x, m: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(m, 1e-9)), 0)
    g = 2 * (part(a, mean * na) + part(b, mean * nb))
    odds = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
    use = (g > 30) & (odds > 2)
    return keys[use], odds[use]


@dataclass
class Model:
    slots: Slots = field(default_factory=lambda: Slots({}, {}))
    words: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    mean: np.ndarray = None
    scale: np.ndarray = None
    text: np.ndarray = None
    meta: np.ndarray = None
    calibrated: list[np.ndarray] = None
    both: np.ndarray = None
    threshold: float = 0.5

    def text_features(self, form: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
        cols = []
        sizes = [len(s) for s in sets]
        every = np.concatenate([*sets, np.zeros(0, U64)])
        text = np.repeat(np.arange(len(sets)), sizes)
        for keys, odds in self.words:
            top, total = np.zeros(len(sets)), np.zeros(len(sets))
            if len(keys) and len(every):
                at = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
                hit = keys[at] == every
                np.maximum.at(top, text[hit], odds[at[hit]])
                pair = np.unique(text[hit] * len(keys) + at[hit])  # each word counts once
                np.add.at(total, pair // len(keys), 1)
            cols += [top, np.log1p(total), total > 0]
        z = (form - self.mean) / self.scale
        return np.concatenate([np.clip(z, -6, 6), np.clip(z, -6, 6) ** 2 / 4, np.stack(cols, axis=1)], axis=1)

    def views(self, form: np.ndarray, sets: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        z = np.stack([linear(self.text, self.text_features(form, sets)), linear(self.meta, metadata(at, self.slots.width))], axis=1)
        return np.stack([linear(c, z[:, [i]]) for i, c in enumerate(self.calibrated)], axis=1) if self.calibrated else z

    def score(self, *features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The probability of good by the text, by the metadata, and by both."""
        z = self.views(*features)
        return sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(linear(self.both, z))


def surely(rounds: list[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """The label that the first sure one of a classifier's rounds (weights, calibration) gives, NaN where none is sure."""
    label = np.full(len(x), np.nan)
    for beta, calibrated in rounds:
        p = sigmoid(linear(calibrated, linear(beta, x)[:, None]))
        new = np.isnan(label) & ((p > SURE) | (p < 1 - SURE))
        label[new] = p[new] > 0.5
    return label


def _thin(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:, :STYLE], x[:, 2 * STYLE :]], axis=1)


def _wide(x: np.ndarray) -> np.ndarray:
    """Text features from those without the squares."""
    return np.concatenate([x[:, :STYLE], x[:, :STYLE] ** 2 / 4, x[:, STYLE:]], axis=1)


def _single(bag: np.ndarray, order: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each bag of words the row of least order: copies would vouch for each other."""
    by = np.lexsort((order, bag[:, 1], bag[:, 0]))
    bag = bag[by]
    new = np.concatenate([[True], (bag[1:] != bag[:-1]).any(1)])[: len(bag)]
    return bag[new], order[by][new], at[by][new], x[by][new]


def _digests(bags: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blake2b(b, digest_size=16).digest() for b in bags), U64).reshape(-1, 2)


class Pool:
    """The unlabelled documents' features, packed. A document's pseudo-labels follow from the earlier rounds' models."""

    def __init__(self, docs: DataFrame, model: Model, labelled: np.ndarray):
        self.width = model.slots.width
        n = parts(docs, 32_000_000, 12)
        own = {b.tobytes() for b in labelled}

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, ...]] = []

            def flush() -> Iterator[pa.RecordBatch]:
                got = _single(*(np.concatenate(c) for c in zip(*held, strict=True)))
                bucket = (got[0][:, 0] % U64(n)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                cuts = [g for g in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(g)]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(bucket[g[0]]) for g in cuts], pa.int32()), "blob": pa.array([pack([c[g] for c in got]) for g in cuts], pa.binary())})

            for rb, texts in slices(batches):
                form, sets = style(texts)
                bag = _digests([distinct(s).tobytes() for s in sets])
                held.append((bag, rb.column("order").to_numpy().copy(), model.slots.at(*(rb.column(c).to_pylist() for c in ("lang", "source", "n_chars"))), _thin(model.text_features(form, sets))))
                if sum(len(h[0]) for h in held) > 50_000:
                    yield from flush()
                    held.clear()
            if held:
                yield from flush()

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [unpack(b) for rb in batches for b in rb.column("blob").to_pylist()]
            if got:
                bag, _, at, x = _single(*(np.concatenate(c) for c in zip(*got, strict=True)))
                new = np.array([b.tobytes() not in own for b in bag], bool)
                yield pa.RecordBatch.from_pydict({"blob": pa.array([pack((at[new], x[new]))], pa.binary())})

        self.rows = kept(docs.mapInArrow(f, "bucket int, blob binary").repartition(n, "bucket").mapInArrow(merged, "blob binary")).coalesce(n)

    def slopes(self, meta: list, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the text classifier, over the documents that the metadata classifier's rounds label."""
        width = self.width

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, bend = np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
            for rb in batches:
                for b in rb.column("blob").to_pylist():
                    at, x = unpack(b)
                    kinds, of = np.unique(at, axis=0, return_inverse=True)
                    y = surely(meta, metadata(kinds, width))[of.ravel()]
                    use = ~np.isnan(y)
                    g, h = slopes(_wide(x[use]), y[use], np.full(use.sum(), 0.5), beta)
                    grad += g
                    bend += h
            yield pa.RecordBatch.from_pydict({"sums": pa.array([np.concatenate([grad, bend.ravel()]).tobytes()], pa.binary())})

        got = sum((np.frombuffer(r.sums) for r in self.rows.mapInArrow(f, "sums binary").collect()), np.zeros(len(beta) * (len(beta) + 1)))
        return got[: len(beta)], got[len(beta) :].reshape(len(beta), -1)

    def tallies(self, text: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, label and count of the documents that the text classifier's rounds label."""

        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                for b in rb.column("blob").to_pylist():
                    at, x = unpack(b)
                    y = surely(text, _wide(x))
                    use = ~np.isnan(y)
                    kinds, n = np.unique(np.column_stack([at[use], y[use].astype(np.int64)]), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in kinds.T), pa.array(n, pa.int64())], ["a", "b", "c", "y", "n"])

        got = self.rows.mapInArrow(f, "a long, b long, c long, y long, n long").groupBy("a", "b", "c", "y").agg(F.sum("n").alias("n")).orderBy("a", "b", "c", "y").toArrow()
        col = lambda c: np.asarray(got.column(c).to_pylist(), np.int64)
        return np.stack([col("a"), col("b"), col("c")], axis=1), col("y").astype(float), col("n").astype(float)


@dataclass
class Start:
    """What the labelled documents give: the model's words and scales, features, and their bags' digests."""

    model: Model
    text: np.ndarray
    at: np.ndarray
    good: np.ndarray
    bags: np.ndarray


def trivial() -> Model:
    """Every document is good."""
    none = np.zeros(0, U64), np.zeros(0)
    m = Model(words=[none, none], mean=np.zeros(STYLE), scale=np.ones(STYLE), text=np.zeros(2 * STYLE + 7), both=np.array([0, 0, 2.0]))
    m.meta = np.zeros(m.slots.width + 1)
    return m


def held_out(n: int) -> np.ndarray:
    return np.arange(n) % 5 == 4  # the sample is in hash order


def begin(form, sets, meta, quality, toxic, bags) -> Start | None:
    """meta: languages, sources and lengths. None without labels of both kinds."""
    good = (quality == 1) & (toxic == 0)
    if len(good) < 20 or good.all() or not good.any():
        return None
    fit = ~held_out(len(good))
    m = Model(slots=Slots.of(*meta[:2]), mean=form[fit].mean(0), scale=form[fit].std(0) + 1e-3)
    some = [s for s, f in zip(sets, fit, strict=True) if f]
    m.words = [marking(some, toxic[fit] == 1), marking(some, quality[fit] == 0)]
    return Start(m, m.text_features(form, sets), m.slots.at(*meta), good, bags)


def co_train(start: Start, pool: Pool) -> Model:
    """Fit on the labelled documents and all of the pool."""
    m, xt, y = start.model, start.text, start.good.astype(float)
    wide = m.slots.width
    xm = metadata(start.at, wide)
    test = held_out(len(y))
    fit = ~test
    one = np.ones(fit.sum())
    rounds: list[list] = [[], []]  # of the text and of the metadata classifier
    for turn in range(ROUNDS + 1):
        more, (at, said, n) = None, (np.zeros((0, 3), np.int64), np.zeros(0), np.zeros(0))
        if turn:
            more, (at, said, n) = (lambda beta: pool.slopes(rounds[1], beta)), pool.tallies(rounds[0])
        text = logistic(xt[fit], y[fit], one, more=more)
        meta = logistic(np.concatenate([xm[fit], metadata(at, wide)]), np.concatenate([y[fit], said]), np.concatenate([one, n / 2]))
        z = [linear(text, xt), linear(meta, xm)]
        m.calibrated = [logistic(zi[test][:, None], y[test], np.ones(test.sum()), 0.1) for zi in z]
        rounds[0].append((text, m.calibrated[0]))
        rounds[1].append((meta, m.calibrated[1]))
    m.text, m.meta = text, meta
    both = np.stack([linear(c, zi[:, None]) for c, zi in zip(m.calibrated, z, strict=True)], axis=1)
    m.both = logistic(both[test], y[test], np.ones(test.sum()), 0.1)
    return m


_FEATURES = "doc_id long, quality int, toxic int, form binary, words binary, lang string, source string, n_chars long"


def _columns(docs: DataFrame) -> list:
    of = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    return [F.coalesce(of("text", "string"), F.lit("")).alias("text"), of("lang", "string"), of("source", "string"), of("n_chars", "long")]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_columns(docs))
    chosen = F.broadcast(known.orderBy(F.xxhash64(F.lit(1), "doc_id")).limit(labelled).select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic"))  # at most `labelled` rows

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, texts in slices(batches):
            form, sets = style(texts)
            same = [rb.column(c) for c in ("doc_id", "quality", "toxic", "lang", "source", "n_chars")]
            yield pa.RecordBatch.from_arrays(
                [*same[:3], pa.array([x.tobytes() for x in form], pa.binary()), pa.array([distinct(s).tobytes() for s in sets], pa.binary()), *same[3:]],
                ["doc_id", "quality", "toxic", "form", "words", "lang", "source", "n_chars"],
            )

    def learn(group: pa.Table) -> pa.Table:
        ids, bags = group.column("doc_id").to_pylist(), group.column("words").to_pylist()
        key = sorted(range(group.num_rows), key=lambda i: (ids[i] * 0x9E3779B97F4A7C15 & 0xFFFFFFFF, bags[i]))
        seen: set[bytes] = set()
        key = [i for i in key if not (bags[i] in seen or seen.add(bags[i]))]  # copies would vouch for each other
        group = group.take(key)
        bags = group.column("words").to_pylist()
        form = np.frombuffer(b"".join(group.column("form").to_pylist()), np.float64).reshape(group.num_rows, -1)
        meta = [group.column(c).to_pylist() for c in ("lang", "source", "n_chars")]
        got = begin(form, [np.frombuffer(b, U64) for b in bags], meta, *(np.array(group.column(c).to_pylist()) for c in ("quality", "toxic")), _digests(bags))
        return pa.table({"start": pa.array([pack(got)], pa.binary())})

    # the labelled sample is bounded, so one task on an executor can see its words and the driver gets features alone
    got = cols.join(chosen, "doc_id").mapInArrow(f, _FEATURES).withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "start binary").first()
    start = unpack(got.start) if got else None
    if start is None:
        return trivial()
    rest = cols.join(chosen.select("doc_id"), "doc_id", "left_anti").select(F.xxhash64(*cols.columns).alias("order"), *cols.columns[1:])
    return co_train(start, Pool(rest, start.model, start.bags))


SCORED = "text_score double, meta_score double, score double, good boolean"


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(row, text_score, meta_score, score, good): row is the document's whole row as a struct.

    Nulls and missing metadata columns count as a value of their own; null texts are empty. Labels with a null, or of
    documents that aren't there, are left out; contradicting labels of a document count as bad."""
    model = fit(docs, labels, **how)
    own = docs.columns.index("text") if ("text", "string") in docs.dtypes else None  # a text that the row has already needn't travel twice
    source = docs.select(F.struct("*").alias("row"), *_columns(docs)[own is not None :])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb, texts in slices(batches, lambda rb: rb.column("text") if own is None else rb.column("row").field(own)):
            form, sets = style(texts)
            a, b, both = model.score(form, sets, model.slots.at(*(rb.column(c).to_pylist() for c in ("lang", "source", "n_chars"))))
            yield pa.RecordBatch.from_arrays([rb.column("row"), *(pa.array(x, pa.float64()) for x in (a, b, both)), pa.array(both >= model.threshold)], ["row", "text_score", "meta_score", "score", "good"])

    return source.mapInArrow(f, f"row {source.schema['row'].dataType.simpleString()}, {SCORED}")
