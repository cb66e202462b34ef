import hashlib
import random
import re
from fractions import Fraction

import pytest

from textloom.llm import contamination, fingerprints, html, mixing, quality, urls

SF = "/root/testdata/sf0.01"


def test_urls_equal_brute_force(spark):
    r = random.Random(2)
    hosts = ["com", "a.com", "Example.COM", "www.example.com", "notexample.com", "example.net", "x.example.net", "net", "org", "b.org", "orgx", "", "com.", ".com", "é.com"]
    paths = ["/en/", "/en/7", "/en/77/x", "/de/", "/de/8?q=/en/", "/es/#a", "/EN/", "", "/en", "?x=/en/"]
    data = [(i, f"http{r.choice(['', 's'])}://{r.choice(hosts)}{r.choice(paths)}") for i in range(400)]
    data += [(900, None), (901, ""), (902, "example.com/en/7"), (903, "a://b://example.com/en/7"), (904, "x://example.com/en/7\n/y"), data[0], (905, "http://example.com" + "/en/7" * 5000)]

    def want(i, url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        return i, host, path, best[2], best[3]

    df = spark.createDataFrame([(*d, "z") for d in data], "page_id long, url string, rule string")
    expect = sorted(repr(want(*d)) for d in data)
    table = spark.createDataFrame([*urls.RULES, ("zzz", None, "/"), ("aaa", "com", "/en/")], "verdict string, host string, path string")
    for rules, small in ((urls.RULES, urls.SMALL), (urls.RULES, 0), (table, urls.SMALL), (table, 0)):
        assert sorted(map(repr, map(tuple, urls.judge(df, rules, small=small).collect()))) == expect
        assert urls.judge(spark.createDataFrame([], "page_id long, url string"), rules, small=small).collect() == []
    assert {x.verdict for x in urls.judge(df, [], "keep").collect()} == {x.verdict for x in urls.judge(df, [], "keep", small=-1).collect()} == {"keep"}


def test_many_rules_are_joined_by_ranges(spark):
    r = random.Random(9)
    hosts = [".".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(80)]
    paths = ["/" + "/".join(r.choice(["x", "y", "zz"]) for _ in range(r.randint(0, 5))) for _ in range(60)]
    rules = [(r.choice(["allow", "block"]), r.choice(hosts), r.choice(paths)[: r.randint(0, 6)]) for _ in range(300)]
    data = [(i, f"s://{r.choice(hosts)}{r.choice(paths)}") for i in range(900)] + [(1000 + i, "s://a.b.c/x/y/zz") for i in range(300)]
    last = {(h, p): v for v, h, p in rules}

    def want(i, url):
        host, slash, path = url.split("://")[1].partition("/")
        path = slash + path
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in last.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        return i, host, path, best[2], best[3]

    df = spark.createDataFrame(data, "page_id long, url string")
    few = spark.createDataFrame([(v, h, p) for (h, p), v in last.items()], "verdict string, host string, path string")
    got = urls._joined(urls._parts(df), few, "allow", each=50).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(want(*d)) for d in data)
    assert sorted(map(repr, map(tuple, urls.judge(df, rules).collect()))) == sorted(repr(want(*d)) for d in data)


def brute_targets(sizes, weights=(5, 2, 1), share=Fraction(3, 2), limit=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > limit * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in open_}
        for s in full:
            out[s] = Fraction(limit * sizes[s])
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark):
    r = random.Random(4)
    data = [(i, " ".join("ab" for _ in range(r.randint(0, 40))), r.choice(["big", "big", "big", "tiny", None, "mid", "mid"]), "t") for i in range(2000)]
    data += [(None, "a b", "mid", "t"), (7000, None, "mid", "t"), (7001, "a\x0bb\x1cc", "none", "t"), data[5], data[5]]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, target string")
    got = mixing.mix(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s, _ in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for g in got:
        s = g.row.source
        assert g.size == size(g.row.text) and g.source_size == sizes[s] and g.target == pytest.approx(float(want[s])) and 0 <= g.copies <= 2
        taken[s] += g.size * g.copies
    assert all(abs(taken[s] - want[s]) <= 40 * 4 * len(data) ** 0.5 / 2 for s in sizes)
    assert sorted((repr(g.row), g.copies) for g in got) == sorted((repr(g.row), g.copies) for g in mixing.mix(df).collect())
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df, small=0).collect()))  # sources too many to send
    for x in got:  # the copies by another road
        rate = want[x.row.source] / sizes[x.row.source] if sizes[x.row.source] else 0
        u = int(hashlib.md5(f"42:{'' if x.row.doc_id is None else x.row.doc_id}:{x.row.text or ''}".encode()).hexdigest()[:13], 16) / 2**52
        assert x.copies == int(rate) + (u < float(rate) - int(rate))
    assert mixing.mix(df.limit(0)).collect() == mixing.mix(df.limit(0), small=-1).collect() == []


def test_html_on_held_out_pages(spark):
    trained = html.model()
    good = found = asked = 0
    for page in html.labelled_pages(150, seed=99):
        parsed = html.Page(page)
        state = []
        for parent, noise in zip(parsed.parents, parsed.noise):
            state.append(not noise and (parent < 0 or state[parent]))
        want = " ".join(t for node, t in parsed.blocks if state[node])
        blind = re.sub(r" data-noise=1", "", page)
        got, want = set(trained.text(blind).split()), set(want.split())
        good, found, asked = good + len(got & want), found + len(got), asked + len(want)
    assert good / found > 0.98 and good / asked > 0.95  # measured when written: 0.995 and 0.966
    cases = [(1, "u", None), (2, "u", ""), (3, None, "<p>a &amp; b\n\n c<script>x<p>y</script></p>"), (4, "u", "<div" * 2000), (5, "u", "<div>" * 3000 + "deep text"), (6, "u", "plain text only")]
    cases += [(7, "u", "<p>twice</p>"), (7, "u", "<p>twice</p>")]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    rows = {r.page_id: r for r in html.extract(spark.createDataFrame([(*c, "extra") for c in cases], "page_id long, url string, html string, text string")).collect()}
    assert rows[1].text == rows[2].text == "" and rows[3].text == "a & b c" and rows[3].url is None
    assert all(r.n_chars == len(r.text) for r in rows.values())


#: Pages labelled by hand, not by the module's own plans: the page and its main text.
BY_HAND = [
    ("<main><h1>Recipe</h1><ul><li>Salt</li><li>Egg</li></ul><p>Mix.</p></main>", "Recipe Salt Egg Mix."),
    ("<body><div class='post-meta-body content'><p>The council met on Monday and talked about the new bridge.</p></div></body>", "The council met on Monday and talked about the new bridge."),
    ("<header id=top><a href=/>Daily News</a><nav><a href=/a>World</a> <a href=/b>Sport</a></nav></header><article><h2>Rain &amp; wind</h2><p>It rained all day, and the river rose by a metre before dawn.<p>Nobody was hurt.</article><footer>Copyright 2020 Daily News. All rights reserved.</footer>", "Rain & wind It rained all day, and the river rose by a metre before dawn. Nobody was hurt."),
    ("<div id=cookie-banner><p>We use cookies to improve your visit.</p><button>OK</button></div><div class=entry><h1>Notes on tea</h1><p>Green tea is not fermented,\n   black tea is.</p><blockquote>Drink it hot.</blockquote></div><aside class=sidebar><h3>Popular</h3><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></aside>", "Notes on tea Green tea is not fermented, black tea is. Drink it hot."),
    ("<article><h1>How to fix a tyre</h1><p>First take off the wheel, then the tyre itself.</p><table><tr><td>Tool</td><td>Lever</td></tr></table></article><section id=comments><h3>3 comments</h3><div class=comment><p>Great, this really helped me a lot yesterday!</p></div></section>", "How to fix a tyre First take off the wheel, then the tyre itself. Tool Lever"),
    ("<form class=search><label>Search</label><input name=q></form><div class=content><p>One long paragraph of the story, with a <a href=x>link</a> in it, goes here.</p><div class=advert>Buy now, pay later!</div><p>And it goes on to the end.</p></div>", "One long paragraph of the story, with a link in it, goes here. And it goes on to the end."),
    ("<p>Before.</p><button>Go <p>An open button doesn't swallow the rest of the page, which is text.</p>", None),
]


def test_pages_labelled_by_hand():
    trained = html.model()
    for page, want in BY_HAND:
        got = trained.text(page)
        assert got == want if want else "the rest of the page" in got


def test_given_pages(spark):
    """Their article is one element without boilerplate in it; another parser reads it."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.odd, self.text = 0, False, []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.odd |= self.inside > 0 and (tag not in ("article", "p", "h1", "h2", "h3", "b", "br", "i", "em", "strong", "ul", "ol", "li", "a", "blockquote") or any(k in ("class", "id") for k, _ in attrs))
            if tag in ("article", "p", "h1", "h2", "h3", "br", "li", "ul", "ol", "blockquote"):
                self.text.append(" ")

        handle_startendtag = handle_starttag

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            self.text.append(" ")

        def handle_data(self, data):
            self.text.append(data * (self.inside > 0))

    trained, same = html.model(), 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        if r.html and r.html.count("<article>") == 1:
            other = Article()
            other.feed(r.html)
            if not other.odd:
                assert "".join(trained.text(r.html).split()) == "".join("".join(other.text).split())
                same += 1
    assert same > 100


def test_long_broken_pages_take_linear_time():
    import time

    began = time.process_time()
    for part in ("<a ", "<a '", "<div", "<b \"'>", "<!-- ", "<button>", "<script>", "<div class='x"):
        html.model().text(part * (400_000 // len(part)))
    assert time.process_time() - began < 60


def brute_marginals(model, page):
    """By summing over all labelings of a small tree."""
    import itertools
    import math

    odds = [sum(model.log.get(x, 0.0) for x in e) for e in page.evidence()]
    total, one = 0.0, [0.0] * len(odds)
    for s in itertools.product((0, 1), repeat=len(odds)):
        w = (0.05, 0.95)[s[0]]
        for i, o in enumerate(odds):
            w *= math.exp(-o / 2) if s[i] else math.exp(o / 2)
            if i:
                w *= model.edge[s[page.parents[i]]][s[i]]
        total += w
        one = [x + w * y for x, y in zip(one, s)]
    return [x / total for x in one]


def test_messages_give_exact_marginals():
    page = html.Page("<body><nav class=menu><ul><li><a>x</a></ul></nav><article><h1>t</h1><p>some text here</p></article><footer>c</footer>")
    m = html.model()
    assert m.marginals(page) == pytest.approx(brute_marginals(m, page))


def brute_hits(docs, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, t, *_ in docs:
        w, hit, names = split(t), set(), set()
        for i, text in items:
            v = split(text)
            for k in range(max(1, len(v) - size + 1)) if v else ():
                win = v[k : k + size]
                for at in range(len(w) - len(win) + 1):
                    if w[at : at + len(win)] == win:
                        hit.update(range(at, at + len(win)))
                        names.add(str(i))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [contamination.BLOCK, 1])
def test_contamination_equals_brute_force(spark, block, monkeypatch):
    from .test_substring import thue

    monkeypatch.setattr(contamination, "STEP", 50)
    r = random.Random(6)
    v = ["a", "B", "c", "é", "d1", "the", "The"]
    items = [(i, " ".join(r.choice(v) for _ in range(r.choice([0, 2, 5, 10, 14])))) for i in range(25)] + [(30, None), (31, ""), (None, "rare words"), (5, "the the the the"), (40, thue(10))]
    docs = [(i, " ".join(r.choice([r.choice(v), r.choice(items)[1] or "x"]) for _ in range(r.randint(0, 30))), "h", "w") for i in range(60)] + [(99, None, "h", "w"), (100, "", "h", "w"), (None, "rare, WORDS!", "h", "w"), (101, "a " * 3000, "h", "w")]
    docs += [docs[3], docs[3], (102, thue(10, 1), "h", "w"), (103, "x " + thue(10), "h", "w")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit string, key string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda got: sorted(repr((g.row.doc_id, g.n_words, g.n_hit, g.n_items, g.items_sha256, g.contaminated)) for g in got.collect())
    assert rows(contamination.decontaminate(df, b, block=block)) == sorted(map(repr, brute_hits(docs, items)))
    assert contamination.decontaminate(df.limit(0), b, block=block).collect() == []
    assert rows(contamination.decontaminate(df, b.limit(0), block=-block)) == sorted(map(repr, brute_hits(docs, [])))


@pytest.mark.parametrize("within", [1, 3, 6])
def test_proximity_equals_brute_force(spark, within):
    r = random.Random(within)
    v = "one two three four five six".split()
    docs = [(i, " ".join(r.choices(v, [1, 2, 4, 8, 16, 32], k=r.randint(0, 25)))) for i in range(40)] + [(77, None), (78, ""), (3, "One, FIVE six"), (3, "One, FIVE six")]
    asked = [(0, "one five"), (1, "two one"), (2, "three"), (3, "six six four"), (4, "absent one"), (5, None), (6, "!")]
    split = lambda t: re.findall("[a-z]+", (t or "").lower())
    seen = {x: sum(x in split(t) for t in {t for _, t in docs}) for x in [*v, "absent"]}
    want = []
    for q, text in asked:
        some = list(dict.fromkeys(split(text)))
        for d, t in docs if some else ():
            w = split(t)
            rare = min(some, key=lambda x: (seen[x], some.index(x)))
            got = [i for i, x in enumerate(w) if x == rare and all(any(y == z and abs(j - i) <= within for j, z in enumerate(w)) for y in some)]
            want += [(q, d, got)] * bool(got)
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, key string")
    got = contamination.proximity(df, spark.createDataFrame(asked, "query_id int, text string"), within).collect()
    assert sorted((x.query_id, x.row.doc_id, list(x.places)) for x in got) == sorted(want)


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    held = [d for d in known if d % 4 == 1]
    seen = labels.where("doc_id % 4 != 1")  # the test's fold
    got = {r.d: r.good for r in quality.classify(docs, seen).selectExpr("row.doc_id as d", "good").collect()}
    assert len(got) == docs.count() and sum(got[d] == known[d] for d in held) / len(held) > 0.9
    again = {r.d: r.good for r in quality.classify(docs.repartition(5), seen).selectExpr("row.doc_id as d", "good").collect()}
    assert got == again
    odd = spark.createDataFrame([(1, None, None), (None, "x", "y"), (2, "", "s"), (2, "", "s"), (3, "w " * 50000, "s")], "doc_id long, text string, score string")
    rows = quality.classify(odd, seen).collect()
    assert len(rows) == 5 and all(r.good for r in rows)  # no labels fit these documents
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_quality_learns_from_all_unlabelled_documents(spark):
    import numpy as np

    r = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        bad = r.random() < 0.4
        text = " ".join(r.choice("abcdefgh") + str(r.randint(0, 99)) for _ in range(r.randint(3, 30))) + (" filth !!!" if bad and r.random() < 0.8 else "")
        row = (i, text, r.choice(["en", "xx"]), "dump" if bad and r.random() < 0.97 else r.choice(["wiki", "news"]), len(text))
        rows.append((i, "the same text", "en", "wiki", 13) if i % 50 == 7 else row)  # whichever copy stays, it is the same
        if i % 20 == 0:
            labels.append((i, int(not bad), int(bad and i % 40 == 0)))
    cols = ("doc_id", "text", "lang", "source", "n_chars")
    got = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(7), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))

    known = {d: (q, t) for d, q, t in labels}
    form, sets = quality.style([x[1].encode() for x in rows])
    bags = [np.unique(s).tobytes() for s in sets]
    seen, yes, no = set(), [], []
    for d in sorted(known, key=lambda d: (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFF, bags[d])) + [x[0] for x in rows if x[0] not in known]:
        if bags[d] not in seen:
            seen.add(bags[d])
            (yes if d in known else no).append(d)
    assert len(no) > 5000
    start = quality.begin(form[yes], [sets[i] for i in yes], list(zip(*(rows[i][2:] for i in yes))), *(np.array([known[i][j] for i in yes]) for j in (0, 1)), None)
    x, kinds = start.model.text_features(form[no], [sets[i] for i in no]), start.model.slots.at(*zip(*(rows[i][2:] for i in no)))

    class Local:  # every document in one array, labels as the rounds give them
        def slopes(self, meta, beta):
            y = quality.surely(meta, quality.metadata(kinds, start.model.slots.width))
            use = ~np.isnan(y)
            self.used = use.sum()
            return quality.slopes(x[use], y[use], np.full(use.sum(), 0.5), beta)

        def tallies(self, text):
            y = quality.surely(text, x)
            use = ~np.isnan(y)
            return kinds[use], y[use], np.ones(use.sum())

    want = quality.co_train(start, local := Local())
    assert local.used > 1000
    for name in ("text", "meta", "both"):
        assert np.allclose(getattr(got, name), getattr(want, name), atol=1e-6), name


def test_quality_holds_little_of_a_batch(spark, monkeypatch):
    """Peak memory of each function that makes features, over one batch of 16 MB of text."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Caught(Exception):
        pass

    def catch(self, f, schema):
        raise Caught(f)

    def caught(of, *args):
        with pytest.raises(Caught) as got:
            of(*args)
        return got.value.args[0]

    r = random.Random(3)
    some = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 999)) for _ in range(400)) for _ in range(400)]
    texts = [f"{some[i % 400]} n{i}" for i in range(8000)] + [None, "", "w " * 50000, None]
    n = len(texts)
    docs = spark.createDataFrame([(1, "a", "en", "wiki", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.trivial()
    form, (keys,) = quality.style([texts[0].encode()])
    model.words = [(np.unique(keys), np.full(len(np.unique(keys)), 3.0))] * 2
    model.text = np.linspace(-1, 1, len(model.text))
    monkeypatch.setattr(type(docs), "mapInArrow", catch)
    fit = caught(quality.fit, docs, labels)
    pool = caught(quality.Pool, docs, model, np.zeros((0, 2), np.uint64))
    monkeypatch.setattr(quality, "fit", lambda *_, **__: model)
    score = caught(quality.classify, docs, labels)

    def batch(rows):
        own = {"doc_id": pa.array(range(len(rows)), pa.int64()), "text": pa.array(rows, pa.string())} | {c: pa.array(["x"] * len(rows)) for c in ("lang", "source")} | {"n_chars": pa.array([5] * len(rows), pa.int64())}
        more = {"order": own["doc_id"], "quality": pa.array([1] * len(rows), pa.int32()), "toxic": pa.array([0] * len(rows), pa.int32())}
        row = pa.StructArray.from_arrays(list(own.values()), list(own))
        return pa.RecordBatch.from_pydict(own | more | {"row": row, "text": own["text"].fill_null("")})

    whole = batch(texts)
    for f in (score, fit, pool):
        list(f(iter([batch(texts[:10])])))  # tables that stay
        tracemalloc.start()
        rows = 0
        for out in f(iter([whole])):
            rows += out.num_rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert f is pool or rows == n
        assert peak < 75e6, (f, peak)
    got = [x for rb in score(iter([whole])) for x in rb.column("score").to_pylist()]
    want = [rb.column("score").to_pylist()[0] for i in [*range(0, 8000, 500), *range(8000, n)] for rb in score(iter([batch(texts[i : i + 1])]))]
    assert np.allclose([got[i] for i in [*range(0, 8000, 500), *range(8000, n)]], want, atol=1e-12)
    assert [x for rb in score(iter([whole])) for x in rb.column("row").field(1).to_pylist()] == texts
    assert list(score(iter([batch([])]))) == []


def brute_sketch(text):
    """By hashing each shingle's own bytes."""
    import numpy as np

    from textloom.llm.common import Prefix

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    every = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        b = " ".join(w[i : i + 5]).encode()
        every.add(int(Prefix(np.frombuffer(b, np.uint8)).of(np.array([0]), np.array([len(b)]))[0]) >> 30)
    kept = sorted(h for h in every if h < 1 << 32)
    return "".join(f"{h:08x}" for h in kept) if kept or not every else f"~{min(every):09x}"


def brute_likeness(a, b):
    x, y = ({f} if f.startswith("~") else {f[i : i + 8] for i in range(0, len(f), 8)} for f in (a, b))
    return len(x & y) / min(len(x), len(y)) if x and y else float(x == y)


@pytest.mark.parametrize("each", [8_000_000, 100])
def test_fingerprints_equal_brute_force(spark, each):
    r = random.Random(8)
    data = [(i * 3, " ".join(r.choice("abcdefghij") + str(r.randint(0, 9)) for _ in range(r.choice([2, 6, 300]) and r.randint(0, 300)))) for i in range(50)]
    data += [(200, None), (201, ""), (None, "last one é"), (None, "two words"), (202, "two words"), (7, "x " * 9000), data[4], data[4], (12, "same id, other text"), (12, "third\ttext of one id")]
    df = spark.createDataFrame([(*d, "e", "f") for d in data], "doc_id long, text string, fingerprint string, range string")
    got = fingerprints.fingerprint(df, each).collect()
    order = [(x.doc_id, x.text or "") for x in df.selectExpr("*", "xxhash64(text) as tie").orderBy(df.doc_id.asc_nulls_last(), "tie").collect()]
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, g = brute_sketch(t), brute_sketch(edited)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, g, brute_likeness(f, g), brute_likeness(f, brute_sketch(after))))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert fingerprints.fingerprint(df.limit(0)).collect() == []
    alone = fingerprints.fingerprint(df.where("doc_id = 7")).collect()
    assert [(x.doc_id, x.near_next) for x in alone] == [(7, 1.0)]


def test_fingerprints_contain_and_unite():
    r = random.Random(9)
    big = " ".join(f"w{i}" for i in range(4000))
    a, b = fingerprints.sketches([big, " ".join(f"w{i}" for i in range(500, 1000))])
    assert fingerprints.likeness(a, b) > 0.9
    for n in [6] * 150 + [64] * 50:  # the shorter ones have marks
        w, cut = big.split()[: n + 64], r.randint(5, n)
        at = r.randint(0, 2000)
        w = big.split()[at : at + n + cut]
        parts = [fingerprints.written(x) for x in fingerprints.sketches([" ".join(w[: cut + 4]), " ".join(w[cut:])])]
        assert fingerprints.merge(*parts) == fingerprints.written(fingerprints.sketches([" ".join(w)])[0])


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs, steps = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        steps.append((docs, docs := spark.read.parquet(str(tmp_path / name))))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    for before, after in steps[:-1]:
        assert after.columns == before.columns == list(corpus_pipeline.COLUMNS) and ids(after) <= ids(before)
    before, after = steps[0]
    good = quality.classify(before, spark.read.parquet(str(tmp_path / "labels.parquet"))).where("good").select("row.*")
    assert sorted(map(repr, good.collect())) == sorted(map(repr, after.collect())) and 0 < after.count() < before.count()
    known = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(str(tmp_path / "labels.parquet")).collect()}
    stay = ids(after)
    assert sum((d in stay) == ok for d, ok in known.items()) / len(known) > 0.85  # 78 of 87 when written
    from .test_near import brute

    before, after = steps[1]
    classes = brute([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == {c for _, c in classes}
    from .test_substring import kept_bytes

    before, after = steps[2]
    want = {(d, b.decode("utf-8", "ignore"), b == (t or "").encode()) for d, b, t in kept_bytes([(r.doc_id, r.text) for r in before.collect()])}
    want = {(d, t) for d, t, whole in want if whole or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {(r.doc_id, r.text) for r in after.collect()} == want and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = steps[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(str(tmp_path / "benchmark.parquet")).collect()]
    assert ids(after) == {d for d, *_, bad in brute_hits([(r.doc_id, r.text) for r in before.collect()], items) if not bad}
    before, after = steps[4]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows, sizes = before.collect(), {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    target, want = brute_targets(sizes), []
    for r in rows:
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        u = int(hashlib.md5(f"42:{r.doc_id}:{r.text}".encode()).hexdigest()[:13], 16) / 2**52
        want += [(r.doc_id, r.text, k) for k in range(int(rate) + (u < float(rate) - int(rate)))]
    assert sorted((r.doc_id, r.text, r["copy"]) for r in after.collect()) == sorted(want)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, steps[-1][1].collect()))
