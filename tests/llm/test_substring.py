import hashlib
import random
import re

import numpy as np
import pytest

from textloom.llm.bwt import build, classes, intervals, merge
from textloom.llm.substring import dedup_bytes, dedup_words, word_classes

SCHEMA = "doc_id long, text string, batch string, k string"  # extra columns with names used inside


def corpus(seed, n=60, hot=False):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    shared = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 60))) for _ in range(3 if hot else 8)]
    rows = []
    for i in range(n):
        parts = [r.choice(shared) if r.random() < 0.6 else " ".join(r.choice(vocab) for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 4))]
        rows.append((i, r.choice([" ", "\n", "  "]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, "ab" * 400), (n + 3, "x " * 300), (None, rows[3][1]), (None, "only here " * 30), (5, rows[6][1]), rows[7], rows[7], (n + 9, "é" * 260)]
    return [(*x, "a", "b") for x in rows]


def covered_bytes(rows, k=100):
    """Each row's bytes and which of them go."""
    first, big = {}, 1 << 62
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - k + 1):
            key = (big if d is None else d, i)
            first[b[i : i + k]] = min(first.get(b[i : i + k], key), key)
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - k + 1):
            if (big if d is None else d, i) > first[b[i : i + k]]:
                gone[i : i + k] = [True] * k
        yield d, t, b, gone


def kept_bytes(rows):
    return [(d, bytes(x for x, g in zip(b, gone) if not g), t) for d, t, b, gone in covered_bytes(rows)]


def brute_bytes(rows):
    out = []
    for d, _, b, gone in covered_bytes(rows):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(rows, k=13):
    first, big = {}, 1 << 62
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for d, t, *_ in rows:
        w = split(t)
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, big), big if d is None else d)
    out = []
    for d, t, *_ in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if (big if d is None else d) > first[tuple(w[i : i + k])]:
                gone[i : i + k] = [True] * k
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def thue(n, bit=0):
    """2**n letters whose polynomial hashes modulo a power of two equal those of their complement."""
    t = "a" if not bit else "b"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("hot", [2000, 20, 1])
def test_both_equal_brute_force(spark, hot):
    rows = corpus(hot, hot=hot < 100)
    df = spark.createDataFrame(rows, SCHEMA)
    assert ordered(tuple(r) for r in dedup_bytes(df, hot=hot).collect()) == ordered(brute_bytes(rows))
    assert ordered(tuple(r) for r in dedup_words(df, hot=hot).collect()) == ordered(brute_words(rows))


def test_windows_are_compared_themselves(spark):
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(i, f"{thue(10)} {tail}", "", "") for i in range(300)] + [(400, f"{thue(10, 1)} {tail}", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (2000, 20):
        got = {r.doc_id: r.n_removed for r in dedup_words(df, hot=hot).collect()}
        assert got[400] == 0 and got[0] == 0 and got[1] == 13


def test_common_prefixes():
    r = random.Random(6)
    raw = [bytes(r.choice(b"abc") for _ in range(n)) for n in (70, 300, 10, 200)]
    shards, symbols = build([np.frombuffer(t + bytes(20), np.uint8) for t in raw], 20)
    z, common = merge(shards, symbols, 20)
    at, suffixes = [0] * len(shards), []
    for i in z.tolist():  # the interleave read back
        s, t = shards[i], raw[i] + bytes(20)
        suffixes.append((t + t)[s.suffixes[at[i]] :][:20])
        at[i] += 1
    assert suffixes == sorted(suffixes)
    for a, b, n in zip(suffixes, suffixes[1:], common[1:].tolist()):
        real = next((i for i in range(20) if a[i] != b[i]), 20)
        assert n == 20 if real == 20 else n <= real < n + 16
    assert len(set(intervals(common, 20).tolist())) == len(set(suffixes))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedup_bytes(df).collect() == [] == dedup_words(df).collect()


def test_merged_transforms_class_equal_windows():
    r = random.Random(5)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 90))) for _ in range(80)] + [b"ab" * 50, b"a" * 77]
    for depth in (5, 8, 12, 16, 27, 32, 47):
        got = classes(texts, depth, shard_bytes=500)
        seen, back = {}, {}
        for t, c in zip(texts, got):
            assert len(c) == max(0, len(t) - depth + 1)
            for i, x in enumerate(c.tolist()):
                assert seen.setdefault(t[i : i + depth], x) == x and back.setdefault(x, t[i : i + depth]) == t[i : i + depth]


def test_word_windows_sort():
    a, b = word_classes([b"a b c d", b"b c d e f"], 3)
    assert a[1] == b[0] and len({*a.tolist(), *b.tolist()}) == 4
