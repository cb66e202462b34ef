import random
from collections import Counter
from math import log

from pyspark.sql import functions as F

from textloom.llm.graph import components
from textloom.llm.near import near_duplicates


def rows():
    r = random.Random(11)
    v = [f"w{i}" for i in range(300)]
    out = []
    for g in range(25):
        base = [r.choice(v) for _ in range(r.randint(60, 200))]
        for c in range(r.choice([1, 1, 2, 4])):
            t = list(base)
            for _ in range(r.choice([0, 1, 2, 6]) if c else 0):
                t[r.randrange(len(t))] = r.choice(v)
            out.append((len(out), " ".join(t), "x", "y"))
    n = len(out)
    return [*out, (n, None, "x", "y"), (n + 1, "", "x", "y"), (n + 2, "one two", "x", "y"), (n + 3, "one  two", "x", "y"), (None, out[0][1], "x", "y"), out[3], out[3], (n + 4, "ab " * 5000, "x", "y")]


def brute(data, like=0.8):
    texts = {t or "" for _, t, *_ in data}
    df = Counter(w for _, t, *_ in data for w in set((t or "").split()))
    idf = {w: log((1 + len(data)) / (1 + c)) + 1 for w, c in df.items()}

    def shingles(t):
        w = t.split()
        s = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
        return {k: c * sum(idf[x] for x in k) / len(k) for k, c in Counter(s).items()}

    sh = {t: shingles(t) for t in texts}
    up = {t: t for t in texts}

    def find(t):
        while up[t] != t:
            t = up[t]
        return t

    order = sorted(texts)
    for i, a in enumerate(order):
        for b in order[:i]:
            both = sum(min(sh[a][k], sh[b][k]) for k in sh[a].keys() & sh[b].keys())
            if both and both / (sum(sh[a].values()) + sum(sh[b].values()) - both) >= like:
                up[find(a)] = find(b)
    first = {}
    big = 1 << 62
    for d, t, *_ in data:
        first[find(t or "")] = min(first.get(find(t or ""), big), big if d is None else d)
    return sorted((repr(d), first[find(t or "")]) for d, t, *_ in data)


def test_classes_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, batch string, k string").withColumns({c: F.lit(1) for c in ("bands", "bins", "same", "root", "node")})
    got = near_duplicates(df).collect()
    assert sorted((repr(r.doc_id), r.class_id) for r in got) == brute(data)
    for c, n in Counter(r.class_id for r in got if r["first"]).items():
        assert n == 1 or data.count(data[c]) == n  # equal rows are one document


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 100) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
