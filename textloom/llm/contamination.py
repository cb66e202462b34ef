"""Benchmark decontamination with a positional inverted index.

The index holds, for each term of the test items, the sorted places at which the training documents have it. A phrase is
found from its rarest term's postings, shifted to where the phrase would begin; they are intersected with the shifted
postings of its other terms, from rare to common. Terms that no test item has are never asked for and have no postings.

There are two layouts of the index, with the same results. `postings` stores one row for each term and document, and
`matches` joins them: any number of documents and items, exact phrases or terms near each other. Where the items fit in
`BLOCK` bytes by their measured size, they go to the documents instead: each part of the documents is indexed where it
lies, all phrases are looked up in it at once, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, chunks, coded, joined, kept, words
from .graph import salted

SIZE = 10
BLOCK = 8_000_000  #: bytes of test items up to which they are sent to the documents
STEP = 500_000  #: places that are looked up at once
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  #: of a lower-cased text
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def terms(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The number of each word, the words by number, and each text's first word."""
    buf, start = joined([t.translate(FOLD) for t in texts])
    s, e = words(buf, _WORD)
    return *coded(buf, s, e, _WORD), np.searchsorted(s, start)


class Phrases:
    """The different windows of the items: their terms, and which items have them."""

    def __init__(self, items: list[tuple], size: int):
        codes, names, first = terms([(t or "").encode() for _, t in items])
        self.size, self.wanted = size, {w: i for i, w in enumerate(names.to_pylist())}
        of: dict[tuple[int, ...], dict] = defaultdict(dict)
        for (item, _), i, j in zip(items, first.tolist(), first[1:].tolist(), strict=False):
            for k in range(i, max(i + 1, j - size + 1)):
                if w := tuple(codes[k : min(k + size, j)].tolist()):
                    of[w][str(item)] = None
        self.items = [list(x) for x in of.values()]
        self.terms = np.array([w + (-1,) * (size - len(w)) for w in of], np.int32).reshape(-1, size)
        self.length = (self.terms >= 0).sum(1)


class Index:
    """Postings of the wanted terms over some texts. Places of different texts are at least `gap` apart."""

    def __init__(self, texts: list[bytes], wanted: dict[bytes, int], gap: int):
        codes, names, self.first = terms(texts)
        self.gap, self.n = gap, len(codes)
        term = np.array([wanted.get(w, -1) for w in names.to_pylist()], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        hit = np.flatnonzero(term >= 0)
        text = np.searchsorted(self.first, hit, "right") - 1
        place, term = hit + text * gap, term[hit]
        order = np.argsort(term, kind="stable")
        self.places, term = place[order], term[order]
        self.cut = np.searchsorted(term, np.arange(len(wanted) + 1))
        self.span = self.n + len(texts) * gap + gap + 1
        self.keys = term * self.span + self.places

    def postings(self, term: int) -> np.ndarray:
        return self.places[self.cut[term] : self.cut[term + 1]]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place is among the postings of its term."""
        key = term * self.span + place
        return self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key

    def phrases(self, asked: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of phrases and the places at which they begin."""
        if not len(self.keys) or not len(asked.terms):
            return
        often = np.where(asked.terms >= 0, np.diff(self.cut)[asked.terms], np.iinfo(np.int64).max)
        live = np.flatnonzero(often.min(1) > 0)
        order = np.argsort(often[live], axis=1, kind="stable")  # rare terms first, absent ones last
        count = often[live, order[:, 0]] if len(live) else np.zeros(0, np.int64)
        edge = np.searchsorted(np.cumsum(count), np.arange(STEP, count.sum() + STEP, STEP), "right")
        for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(live)], strict=True):
            if lo == hi:
                continue
            n = count[lo:hi]
            own = np.repeat(np.arange(lo, hi), n)
            rarest = asked.terms[live[own], order[own, 0]]
            at = self.places[self.cut[rarest] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)] - order[own, 0]
            for k in range(1, asked.size):
                i = order[own, k]
                term = asked.terms[live[own], i].astype(np.int64)
                ok = (term < 0) | self.has(term, at + i)
                own, at = own[ok], at[ok]
            yield live[own], at

    def text_and_word(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = np.searchsorted(self.first[:-1] + np.arange(len(self.first) - 1) * self.gap, place, "right") - 1
        return text, place - text * self.gap - self.first[text]


def search(texts: list[bytes], asked: Phrases) -> Iterator[tuple[int, int, set]]:
    """For each text: its number of words, how many are hit, and the items found."""
    for lo, hi in chunks(texts, 2_000_000):
        index = Index(texts[lo:hi], asked.wanted, asked.size + 1)
        first = index.first
        edges, items = np.zeros(index.n + 1, np.int64), defaultdict(set)
        for own, at in index.phrases(asked):
            text, word = index.text_and_word(at)
            np.add.at(edges, word + first[text], 1)
            np.add.at(edges, word + first[text] + asked.length[own], -1)
            for t, p in np.unique(np.stack([text, own]), axis=1).T.tolist():
                items[t].update(asked.items[p])
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
        for t in range(hi - lo):
            yield int(first[t + 1] - first[t]), int(hit[first[t + 1]] - hit[first[t]]), items.get(t, set())


# ---------------------------------------------------------------- the stored index


def split(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))


def postings(texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(term, key, places): the sorted places, from 0, at which the text of each key has the term.

    texts has key and text; wanted (term) limits the terms. A null text has no terms."""
    every = texts.select("key", F.posexplode(split(F.col("text"))).alias("place", "term"))
    if wanted is not None:
        every = every.join(wanted.select("term").distinct(), "term", "left_semi")
    return every.groupBy("term", "key").agg(F.sort_array(F.collect_list("place")).alias("places"))


def matches(index: DataFrame, asked: DataFrame, within: int | None = None) -> DataFrame:
    """(phrase, key, places): where each text has each phrase, a string of terms with one blank between.

    Without `within`, the terms follow each other and places are where they begin. With it, the terms may come in any
    order, and places are those of the rarest term that have every other one at most `within` words away.
    The rarest term by the number of texts picks the texts; only their postings of the other terms are read."""
    term = asked.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("i", "term"))
    often = index.groupBy("term").agg(F.count("key").alias("n"))
    rare = term.join(often, "term", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "i", "term")).alias("rare"), F.count("i").alias("size"))
    rare = rare.where("rare.n > 0").select("phrase", "size", F.col("rare.i").alias("rare"), "rare.term")
    some = salted(index, rare, ["term"], F.col("key")).select("phrase", "size", "rare", "key", F.col("places").alias("own"))
    other = some.join(term, "phrase").where("i != rare").join(index, ["key", "term"])
    lists = other.groupBy("phrase", "key").agg(F.collect_list(F.struct("i", "places")).alias("lists"))
    some = some.join(lists, ["phrase", "key"], "left").withColumn("lists", F.coalesce("lists", F.array().cast(lists.schema["lists"].dataType))).where("size(lists) = size - 1")
    if within is None:
        start = F.transform("own", lambda p: p - F.col("rare"))
        got = F.aggregate("lists", start, lambda kept_, x: F.array_intersect(kept_, F.transform(x["places"], lambda p: p - x["i"])))
    else:
        got = F.filter("own", lambda p: F.forall("lists", lambda x: F.exists(x["places"], lambda q: F.abs(q - p) <= within)))
    return some.select("phrase", "key", got.alias("places")).where("size(places) > 0")


def windows(items: DataFrame, size: int) -> DataFrame:
    """(item, phrase): each item's windows, or the item as a whole if it is shorter."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("None")).alias("item"), split(F.col("text")).alias("w")).where("size(w) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))))
    return w.select("item", "w", at.alias("at")).select("item", F.array_join(F.slice("w", F.col("at"), F.lit(size)), " ").alias("phrase")).distinct()


def _stored(source: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    keyed = source.withColumn("key", F.sha2("text", 256))  # equal texts fare alike
    asked = kept(windows(benchmark, size))
    index = kept(postings(keyed.select("key", "text").dropDuplicates(["key"]), asked.select(F.explode(F.split("phrase", " ")).alias("term"))))
    got = kept(matches(index, asked.select("phrase")))
    cover = got.select("key", F.explode("places").alias("p"), F.size(F.split("phrase", " ")).alias("n")).select("key", F.explode(F.expr("sequence(p, p + n - 1)")).alias("p"))
    hits = cover.groupBy("key").agg(F.countDistinct("p").alias("n_hit"))
    items = got.join(asked, "phrase").select("key", "item").distinct().groupBy("key").agg(F.count("item").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    x = salted(keyed, hits.join(items, "key"), ["key"], F.col("row.doc_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return x.select("row", F.size(split(F.col("text"))).cast("long").alias("n_words"), zero("n_hit"), zero("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def proximity(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(query_id, row, places) of each query (query_id, text) and document: the places, from 0, of the query's rarest word
    that have all its other words at most `within` words away. row is the document's whole row as a struct.

    Words as in `decontaminate`. Nulls and texts without words find nothing; equal rows are found each."""
    source = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("key"), F.col("text").cast("string").alias("text"))
    asked = queries.select("query_id", F.array_join(F.array_distinct(split(F.col("text"))), " ").alias("phrase")).where("phrase != ''")
    index = kept(postings(source.select("key", "text").dropDuplicates(["key"]), asked.select(F.explode(F.split("phrase", " ")).alias("term"))))
    got = kept(matches(index, asked, within))
    few = got.join(asked, "phrase").select("query_id", "key", "places")
    return salted(source.drop("text"), few, ["key"], F.col("row.doc_id")).select("query_id", "row", "places")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """(row, n_words, n_hit, n_items, items_sha256, contaminated): row is the document's whole row as a struct.

    A-Z are lower-cased; words are runs of ASCII letters, digits and non-ASCII characters, compared as bytes. A window
    is `size` consecutive words of an item, or a shorter item as a whole; items and documents without words, and nulls,
    match nothing. A null item_id counts as the text 'None'. Items that share an id count once. items_sha256 is the
    SHA-256 of the found item_ids as sorted strings joined by commas (of the empty string where none is found).
    Equal rows fare alike; an empty table gives no rows, an empty benchmark finds nothing."""
    source = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    measured = benchmark.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 16)).first()[0] or 0
    if measured > block:
        return _stored(source, benchmark, size)
    asked = Phrases([tuple(r) for r in benchmark.select("item_id", F.col("text").cast("string")).collect()], size)  # at most `block` bytes

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            n, hit, names = zip(*search(binary(rb.column("text")), asked), strict=True) if rb.num_rows else ((), (), ())
            names = [sorted(x) for x in names]
            arrays = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, names), pa.int64()), pa.array((hashlib.sha256(",".join(x).encode()).hexdigest() for x in names), pa.string()), pa.array((x > 0 for x in hit), pa.bool_())]
            yield pa.RecordBatch.from_arrays([rb.column("row"), *arrays], ["row", *(x.split()[0] for x in FOUND.split(", "))])

    return source.mapInArrow(f, f"row {source.schema['row'].dataType.simpleString()}, {FOUND}")
