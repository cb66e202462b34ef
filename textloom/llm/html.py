"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree. Each node is content or boilerplate; a potential on each edge says how the
states of parent and child go together, and each node has its own evidence: its tag, words in its class and id, how
long its text is and how much of it is links. Sum-product messages, first upward and then downward, give the exact
marginal of every node. Potentials and evidence are counted from labelled pages, which this module makes itself from
page plans: in them boilerplate subtrees carry the attribute `data-noise`.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from html import escape, unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration, or a tag. A tag with an open quote ends at its first `>`, one without any at the page's end.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:\"[^\"]*+\"|'[^']*+'|[^>\"']++)*+)>|([^>]*+)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-noise)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLOCK = frozenset(
    "html body div p article main section nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary hr "
    "dialog menu center hgroup search".split()
)
#: Neither their text nor what is in them is shown as text, or it belongs to a control.
HIDDEN = frozenset("script style noscript template head title iframe object svg math canvas audio video map select textarea button datalist option input".split())
RAW = frozenset("script style noscript iframe textarea title template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}}
BAD = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|footer|foot|header|head|side\w*|ads?|advert\w*|banner|cookies?|notices?|consent|gdpr|comments?|repl(?:y|ies)|respon[ds]\w*|discussion|shar(?:e|ing)|social|promo\w*|related|breadcrumbs?|login|"
    r"sign\w*|newsletter|subscri\w*|popup|modal|widgets?|sponsor\w*|copyright|toolbar|paginat\w*|tags?|meta|recommend\w*|alert|disclaimer|search\w*|form|skip\w*|masthead|complementary|contentinfo|navigation|dialog|outbrain|taboola)(?=$|[\s_-])",
    re.I,
)
GOOD = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|main|body|story|text|prose)(?=$|[\s_-])", re.I)
FAMILY = {**{f"h{i}": "h" for i in range(1, 7)}, **dict.fromkeys(("ul", "ol", "dl", "menu"), "list"), **dict.fromkeys(("li", "dt", "dd"), "li"), **dict.fromkeys(("td", "th", "tr", "tbody", "thead", "tfoot", "caption", "table"), "table")}


class Page:
    """Nodes in page order (a parent before its children) and the text blocks, each with its node."""

    def __init__(self, html: str):
        self.tags, self.parents, self.marks, self.noise = ["html"], [-1], [0], [False]
        self.length, self.linked = [0], [0]
        self.blocks: list[tuple[int, str]] = []
        stack, own, links, hidden = [("html", 0)], [], 0, []
        at, last = 0, {}

        def closed(tag: str) -> bool:
            """Whether the tag's end comes at all."""
            if tag not in last:
                last[tag] = max((m.start() for m in re.finditer(f"</{tag}", html, re.I)), default=-1)
            return last[tag] >= at

        def flush():
            nonlocal own
            if own:
                text = " ".join(unescape("".join(own)).split())
                own = []
                if text:
                    node = stack[-1][1]
                    self.blocks.append((node, text))
                    self.length[node] += len(text)

        while at < len(html):
            m = TOKEN.search(html, at)
            end = m.start() if m else len(html)
            if end > at and not hidden:
                own.append(html[at:end])
                if links:
                    self.linked[stack[-1][1]] += len(html[at:end].strip())
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag, closing = m[2].lower(), bool(m[1])
            if tag in RAW and not closing:
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else len(html)
            elif tag in VOID:
                if tag == "br" and not hidden:
                    own.append(" ")
                elif tag == "hr":
                    flush()
            elif tag in HIDDEN:
                if not closing and (tag == "head" or closed(tag)):
                    hidden.append(tag)
                elif tag in hidden:
                    del hidden[hidden.index(tag) :]
            elif tag == "a":
                links = 0 if closing else 1
            elif tag in BLOCK:
                if tag == "body":
                    hidden.clear()  # an unclosed head
                if hidden:
                    continue
                flush()
                links = 0
                if closing:
                    if any(t == tag for t, _ in stack[1:]):
                        while stack.pop()[0] != tag:
                            pass
                    continue
                attributes = m[3] or m[4] or ""
                if tag == "html":
                    continue
                if stack[-1][0] == "p":
                    stack.pop()
                if tag in CLOSES:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in STOPS[tag]:
                            break
                        if stack[i][0] in CLOSES[tag]:
                            del stack[i:]
                            break
                bad, good, noise = 0, 0, False
                if "=" in attributes:
                    for name, *values in ATTRIBUTE.findall(attributes):
                        value = "".join(values)
                        if name.lower() == "data-noise":
                            noise = True
                        else:
                            bad += len(BAD.findall(value))
                            good += len(GOOD.findall(value))
                mark = 1 if bad > good else 2 if good > bad else 3 * (good > 0)  # words that say boilerplate, content, or both alike
                self.tags.append(tag)
                self.parents.append(stack[-1][1])
                self.marks.append(mark)
                self.noise.append(noise)
                self.length.append(0)
                self.linked.append(0)
                stack.append((tag, len(self.tags) - 1))
        flush()

    def evidence(self) -> Iterator[tuple]:
        for tag, mark, n, links in zip(self.tags, self.marks, self.length, self.linked, strict=True):
            family = FAMILY.get(tag, tag)
            yield ("tag", family), ("mark", mark), ("size", 0 if not n else 1 + (n > 40) + (n > 160)), ("links", 0 if not n else 1 + (2 * links > n), family == "li")


class Model:
    def __init__(self, pages: list[str]):
        seen = [defaultdict(float), defaultdict(float)]
        edge = [[1.0, 1.0], [1.0, 1.0]]
        count = [1.0, 1.0]
        for page in map(Page, pages):
            state: list[int] = []
            for parent, noise, evidence in zip(page.parents, page.noise, page.evidence(), strict=True):
                s = 0 if noise or parent >= 0 and not state[parent] else 1
                state.append(s)
                count[s] += 1
                if parent >= 0:
                    edge[state[parent]][s] += 1
                for x in evidence:
                    seen[s][x] += 1
        self.edge = [[x / sum(row) for x in row] for row in edge]
        self.log = {x: tuple(math.log((seen[s][x] + 0.5) / (count[s] + 5)) for s in (0, 1)) for x in {*seen[0], *seen[1]}}
        self.log = {x: a - b for x, (a, b) in self.log.items()}

    def marginals(self, page: Page) -> list[float]:
        """The probability of each node to be content, by sum-product on the tree."""
        odds = [sum(self.log.get(x, 0.0) for x in e) for e in page.evidence()]
        n, ((t00, t01), (t10, t11)) = len(odds), self.edge
        # own evidence as (boilerplate, content), then times the messages from below
        up = [(1.0, math.exp(-o)) if o > 0 else (math.exp(o), 1.0) for o in odds]
        sent = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            b, c = up[i]
            z = b + c
            b, c = b / z, c / z
            sent[i] = m0, m1 = t00 * b + t01 * c, t10 * b + t11 * c
            p = page.parents[i]
            x0, x1 = up[p][0] * m0, up[p][1] * m1
            z = x0 + x1
            up[p] = (x0 / z, x1 / z)
        b, c = up[0]
        down = [(0.0, 0.0)] * n
        down[0] = (0.05, 0.95)
        out = [0.0] * n
        out[0] = 0.95 * c / (0.05 * b + 0.95 * c)
        for i in range(1, n):
            p = page.parents[i]
            d0, d1 = down[p][0] * up[p][0] / sent[i][0], down[p][1] * up[p][1] / sent[i][1]
            x0, x1 = d0 * t00 + d1 * t10, d0 * t01 + d1 * t11
            z = x0 + x1
            down[i] = x0 / z, x1 / z
            b, c = up[i]
            out[i] = x1 * c / (x0 * b + x1 * c)
        return out

    def text(self, html: str) -> str:
        page = Page(html)
        p = self.marginals(page)
        return " ".join(t for node, t in page.blocks if p[node] > 0.5)


def labelled_pages(n: int = 400, seed: int = 7) -> list[str]:
    """Pages whose boilerplate is marked, from plans that vary what a page has, in which order, and how it is marked up."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("aeioustrnlmdk") for _ in range(r.randint(2, 9))) for _ in range(500)]
    say = lambda a, b: escape(" ".join(r.choice(vocab) for _ in range(r.randint(a, b))).capitalize() + r.choice([".", "!", "?", ""]))
    link = lambda: f'<a href="/{r.choice(vocab)}">{say(1, 3)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(2, 9))) + "</ul>"
    named = lambda *names: f'{r.choice(["class", "class", "id"])}="{r.choice(["", "", "site-", "page-"])}{r.choice(names)}{r.choice(["", "", " box", " wide"])}"'

    def noise(tag: str, inner: str, *names: str) -> str:
        t = r.choice([tag, "div", "section"]) if names and r.random() < 0.4 else tag
        if r.random() < 0.15:
            names = [f"{x}-{r.choice(['content', 'body', 'post', 'text'])}" for x in names]
        attr = named(*names) if names and (t != tag or tag in ("div", "section", "p") or r.random() < 0.4) else ""
        return f"<{t} {attr} data-noise=1>{inner}</{t}>"

    def above() -> list[str]:
        return [
            noise("nav", r.choice([links(), " ".join(link() for _ in range(5))]), "nav", "menu", "navbar", "breadcrumb"),
            noise("header", r.choice([f"<h1>{say(1, 4)}</h1>", f"<p>{say(2, 8)}</p>", f"<div>{say(2, 6)}</div>"]) + r.choice(["", links()]), "header", "masthead", "banner"),
            noise("div", r.choice([say(3, 25), f"<p>{say(5, 30)}</p>"]), "notice", "cookie", "cookie-notice", "consent", "alert", "banner"),
        ]

    def odd() -> list[str]:
        return [
            noise("div", r.choice([say(3, 25), f"<p>{say(5, 30)}</p>", link()]), "ad", "ads", "advert", "promo", "sponsored"),
            noise("aside", r.choice([f"<h2>{say(1, 3)}</h2>" + links(), f"<p>{say(3, 30)}</p>", say(5, 20)]), "sidebar", "related", "widget"),
            noise("form", f"<label>{say(1, 4)}</label><p>{say(1, 12)}</p><input name=q>", "form", "newsletter", "login", "search"),
            noise("div", say(3, 20), "share", "social", "tags"),
        ]

    def below() -> list[str]:
        each = lambda: r.choice([f"<p>{say(3, 40)}</p>", f"<div class=\"{r.choice(['comment', 'reply'])}\"><p>{say(3, 40)}</p></div>", f"<article class=\"comment\"><p>{say(3, 40)}</p></article>", f"<li>{say(3, 30)}</li>"])
        return [
            noise("section", f"<h{r.choice('234')}>{say(1, 3)}</h3>" + "".join(each() for _ in range(r.randint(1, 6))), "comments", "comment-list", "responses", "discussion"),
            noise("footer", r.choice([f"&copy; {say(2, 15)}", f"<p>{say(3, 20)}</p>" + links()]), "footer", "copyright"),
        ]

    pages = []
    for _ in range(n):
        story = [f"<h1>{say(2, 9)}</h1>"] * (r.random() < 0.8)
        for _ in range(r.randint(1, 14)):
            story.append(r.choices([f"<p>{say(1, 80)}</p>", f"<p><b>{say(2, 9)}</b><br>{say(5, 60)}", f"<h{r.choice('23')}>{say(1, 6)}</h2>", "<ul>" + "".join(f"<li>{say(1, r.choice([3, 20]))}" for _ in range(r.randint(2, 8))) + "</ul>", f"<blockquote><p>{say(5, 40)}</p></blockquote>", f"<pre>{say(3, 20)}</pre>", f"<p>{say(5, 30)} {link()} {say(5, 40)}</p>", f"<table><tr><td>{say(1, 4)}<td>{say(1, 4)}</table>", f"<div>{say(5, 60)}</div>"], [9, 2, 2, 2, 1, 1, 2, 1, 1])[0])
        for x in r.sample(odd(), r.choice([0, 0, 1, 2])):
            story.insert(r.randint(0, len(story)), x)
        if r.random() < 0.15:
            story += below()[:1]
        kind = r.choice(["article", "article", "main", "div", "bare"])
        inner = "".join(story)
        if kind == "div":
            inner = f"<div {named('content', 'post', 'entry', 'article', 'story', 'main', 'post-meta-body content', 'entry-form main-content')}>{inner}</div>"
        elif kind != "bare":
            inner = f"<{kind} {r.choice(['', named('content', 'post')])}>{inner}</{kind}>"
        if r.random() < 0.3:
            inner = f"<{r.choice(['div', 'main', 'section'])} {r.choice(['', named('content', 'main')])}>{inner}</div>"
        body = r.sample(above(), r.randint(1, 3)) + r.sample(odd(), r.choice([0, 1, 2])) + [inner] + r.sample(odd(), r.choice([0, 1, 2])) + [x for x in below() if r.random() < 0.7]
        if r.random() < 0.3:
            body = ["<div>", *body, "</div>"]
        pages.append(f"<html><head><title>x</title></head><body>{''.join(body)}</body></html>")
    return pages


@cache
def model() -> Model:
    return Model(labelled_pages())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, '' for a null or empty one; rows are independent."""
    trained = model()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            texts = [trained.text(h) for h in rb.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column("page_id"), rb.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    html = F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    return pages.select("page_id", "url", html).mapInArrow(f, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
