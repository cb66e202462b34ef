import math
import random
import re
import zlib
from collections import Counter

from textloom.llm.lm import score


def rows(n=80):
    r = random.Random(3)
    v = ["the", "The", "of", "é", "word", "b", "c"] + [f"w{i}" for i in range(40)]
    got = [(i, " ".join(r.choice(v[: 5 + i % 40]) for _ in range(r.randint(0, 40))), "x", "y") for i in range(n)]
    return [*got, (n, None, "x", "y"), (n + 1, "", "x", "y"), (None, "the of", "x", "y"), got[4], got[4], (n + 2, "b " * 3000, "x", "y")]


def tokens(t):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", fold), None]


def test_base_and_model(spark):
    data = rows()
    got = [r.asDict() for r in score(spark.createDataFrame(data, "doc_id long, text string, batch string, key string")).collect()]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    uni, bi, ctx = Counter(), Counter(), Counter()
    for d, t, *_ in data:
        if not held(d):
            w = tokens(t)
            uni.update(w)
            bi.update(zip(["<s>", *w], w))
            ctx.update(["<s>", *w[:-1]])
    n, v = sum(uni.values()), len(uni)
    want = sorted((repr(d), held(d), len(tokens(t)), sum(uni[w] > 0 for w in tokens(t)), n, round(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t, *_ in data)
    assert want == sorted((repr(g["doc_id"]), g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], round(g["base_score"], 6)) for g in got)
    model = brute_model([(tokens(t), zlib.crc32(("" if d is None else str(d)).encode()) // 7 % 5 == 0) for d, t, *_ in data if not held(d)])
    want = sorted((repr(d), len(tokens(t)), round(model(tokens(t)), 6)) for d, t, *_ in data)
    assert want == sorted((repr(g["doc_id"]), g["n_tokens"], round(g["score"], 6)) for g in got)
    out = [g for g in got if g["held_out"]]
    assert out and sum(g["score"] for g in out) > sum(g["base_score"] for g in out)


def brute_model(texts):
    """Deleted interpolation by dictionaries: weights by EM over the tokens of the texts marked for it."""
    uni, bi, ctx = ([Counter(), Counter()] for _ in range(3))  # of all texts, and of those not marked
    for w, tune in texts:
        for k in (0,) if tune else (0, 1):
            uni[k].update(w)
            bi[k].update(zip(["<s>", *w], w))
            ctx[k].update(["<s>", *w[:-1]])
    v, n = len(uni[0]), [sum(u.values()) for u in uni]
    step = lambda p: 2.0 ** (-round(-8 * math.log2(p)) / 8) if p else 0.0
    level = lambda c: min(int(math.log2(max(c, 1))) + (c > 0), 23)
    seen = Counter()
    for w, tune in texts:
        if tune:
            for a, b in zip(["<s>", *w], w):
                c = ctx[1][a]
                seen[level(c), step(bi[1][a, b] / c if c else 0), step(uni[1][b] / n[1])] += 1
    weight = {k: [0.4, 0.4, 0.2] if k else [0, 0.8, 0.2] for k in range(24)}
    for _ in range(60):
        new = {k: [1e-3] * 3 for k in weight}
        for (k, *ps), c in seen.items():
            part = [x * y for x, y in zip(weight[k], [*ps, 1 / (v + 1)])]
            for i in range(3):
                new[k][i] += c * part[i] / sum(part)
        new[0][0] = 0
        weight = {k: [x / sum(row) for x in row] for k, row in new.items()}

    def score_of(w):
        total = 0.0
        for a, b in zip(["<s>", *w], w):
            c = ctx[0][a]
            x, y, z = weight[level(c)]
            total += math.log10(x * (bi[0][a, b] / c if c else 0) + y * uni[0][b] / n[0] + z / (v + 1))
        return total

    return score_of


def test_unknown_words_stay_unknown(spark):
    from .test_substring import thue

    rows = [(i, thue(10)) for i in range(60)]
    for i in range(60, 90):
        rows.append((i, thue(10, 1)))
    held = {d for d, _ in rows if zlib.crc32(str(d).encode()) % 7 == 2}
    got = score(spark.createDataFrame([x for x in rows if x[0] < 60 or x[0] in held], "doc_id long, text string")).collect()
    assert any(x.doc_id >= 60 for x in got) and all(x.n_known == (2 if x.doc_id < 60 else 1) for x in got)


def test_empty(spark):
    assert score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
