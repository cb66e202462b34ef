"""Removal of repeated substrings: by bytes (merged Burrows-Wheeler transforms) and by words (super-k-mers)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bwt
from .common import Batch, chunks, runs, table
from .earlier import HOT, Rule, Units, covered, find


def dedup_bytes(docs: DataFrame, size: int = 100, gram: int = 24, with_text: bool = False, columns: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """Remove each byte that lies in a `size`-byte string which also starts earlier.

    Earlier: in a document with a smaller doc_id, or in the same document further left. Rows that share a doc_id are
    one document here: they repeat each other only at different offsets. A null doc_id comes after all others; a null
    text is empty. Strings are judged on the input. `docs` may have any further columns; they are not read.
    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text also k (xxhash64 of doc_id and text) and
    kept: the remaining text, where bytes that a cut leaves as broken characters are dropped (of a null text: '').
    `columns` are further string or long columns to carry along."""
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", k long, kept string" * with_text
    out += "".join(f", {c} {docs.schema[c].dataType.simpleString().replace('bigint', 'long')}" for c in columns)

    def finish(b: Batch, late: list) -> pa.Table:
        removed, spans, sha, kept = [], [], [], []
        for text, (at, count) in zip(b.texts, late, strict=True):
            if len(at):
                gone = covered(len(text), at, count, size)
                removed.append(int(gone.sum()))
                spans.append(len(runs(gone)[0]))
                text = np.frombuffer(text, np.uint8)[~gone].tobytes()
            else:
                removed.append(0)
                spans.append(0)
            sha.append(hashlib.sha256(text).hexdigest())
            if with_text:
                kept.append(text.decode("utf-8", "ignore"))
        more = dict(zip(columns, b.more, strict=True)) | ({"k": b.k, "kept": kept} if with_text else {})
        return table(out, doc_id=b.id, n_bytes=[len(t) for t in b.texts], n_removed=removed, n_spans=spans, kept_sha256=sha, **more)

    return find(docs, Rule(size, gram, False, True, bwt.classes, hot), out, finish, *(F.col(c) for c in columns))


def word_classes(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The class of each window of `size` words, by sorting the windows themselves."""
    wins: list[bytes] = []
    counts = []
    for t in texts:
        cut = [-1, *np.flatnonzero(np.frombuffer(t, np.uint8) == 32).tolist(), len(t)]
        n = max(0, len(cut) - size)
        wins += [t[cut[i] + 1 : cut[i + size]] for i in range(n)]
        counts.append(n)
    order = sorted(range(len(wins)), key=wins.__getitem__)
    cls = np.zeros(len(wins), np.int64)
    if wins:
        new = [0] + [wins[i] != wins[j] for i, j in zip(order[1:], order, strict=False)]
        cls[order] = np.cumsum(new)
    return np.split(cls, np.cumsum(counts)[:-1]) if counts else []


def dedup_words(docs: DataFrame, size: int = 13, gram: int = 5, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """Remove each word that lies in a window of `size` words which also starts in a document of smaller doc_id.

    Words are maximal runs of bytes other than blanks and U+0009 to U+000D, unchanged. Rows that share a doc_id are one
    document; a null doc_id comes after all others; a null text has no words. Windows are judged on the input.
    Returns doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one blank, and with_text also kept."""
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def finish(b: Batch, late: list) -> pa.Table:
        total, removed, sha, texts = [], [], [], []
        for lo, hi in chunks(b.texts):
            u = Units(b.texts[lo:hi], True)
            data = u.buf.tobytes()
            for i in range(lo, hi):
                w, end = u.first[i - lo], u.first[i - lo + 1]
                at, count = late[i]
                n = int(end - w)
                kept = data[u.s[w] : u.e[end - 1]] if n else b""
                cut = 0
                if len(at):
                    gone = covered(n, at, count, size)
                    cut = int(gone.sum())
                    s, e = runs(~gone)
                    kept = b" ".join(data[u.s[w + i] : u.e[w + j - 1]] for i, j in zip(s.tolist(), e.tolist(), strict=True))
                total.append(n)
                removed.append(cut)
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
        return table(out, doc_id=b.id, n_words=total, n_removed=removed, kept_sha256=sha, **({"kept": texts} if with_text else {}))

    return find(docs, Rule(size, gram, True, False, word_classes, hot), out, finish)

