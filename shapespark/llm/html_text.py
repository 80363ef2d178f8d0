"""Main text of web pages: gradient-boosted trees over features of DOM nodes, then a hierarchical decoding.

Each element gets features of its subtree (lengths, densities of text, links and tags), of its attribute tokens and those of its ancestors,
of its depth, its siblings and its place in the page. Boosted trees, trained on pages that a generator lays out with many kinds of
boilerplate and known labels, give each element the odds that its text is part of the article. Decoding assigns every subtree one of three
states by dynamic programming, all article, all boilerplate, or mixed (at a price), so that an element is never article inside an ancestor
that is boilerplate as a whole, nor the reverse.

Defined cases: null or empty html gives an empty text; a page without an article gives what its nodes score, often an empty text; markup that
isn't closed is closed as browsers do for paragraphs, list items, table parts and at the end; a script or style without an end goes on to the end
of the page; very long or deep pages are read whole, in time in proportion to their length; states that cost the same are taken in the order
article, boilerplate, mixed; rows that share a page_id, or repeat wholly, each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boost import Boosted, fit
from .shared import bounded_batches, table

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
EDGE = re.compile(r"[>\"']")
#: Attributes as most tags have them: double quotes behind "=", closed before the tag's end.
PLAIN = re.compile(r"""[^"'>]*+(?:(?<==)"[^"'>]*+"[^"'>]*+)*+>""")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# fixed values: HTML's own element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template".split())
#: Of these, what isn't closed goes on to the end of the page; others that aren't closed are read as plain elements.
UNREAD = frozenset("script style".split())
FOREIGN = ("svg", "math")
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr big object math mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle semantics".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: What a start tag closes, up to the nearest of the bounds.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# fixed values: words that page authors use in class, id and role attributes
GOOD = frozenset("article content main post entry story body text blog page prose".split())
BAD = {
    "menu": frozenset("nav navbar navigation menu breadcrumb breadcrumbs toolbar tabs pagination pager sitemap".split()),
    "edge": frozenset("header footer masthead banner topbar copyright legal site logo bottom top".split()),
    "side": frozenset("sidebar aside side related widget recommended popular trending more rail links tags".split()),
    "advert": frozenset("ad ads advert advertisement adsense sponsor sponsored promo promotion promoted affiliate".split()),
    "notice": frozenset("cookie cookies consent notice popup modal overlay alert gdpr newsletter subscribe signup login form search share social".split()),
    "comment": frozenset("comment comments reply replies respond disqus discussion feedback thread reader".split()),
}
TAGS = ("p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "li", "a", "h1", "h2", "span", "td", "body", "blockquote", "figure", "pre", "button", "noscript")
NEVER = frozenset("script style iframe template svg head title select textarea button input form nav".split())
WIDTH = len(TAGS) + 1 + 2 * (1 + len(BAD)) + 22


class Scanner:
    """Cuts a page's source into ("text", "", text), ("start", name, attributes) and ("end", name, ""), in time in proportion to its length. A
    quote opens a value only after "="; one that isn't closed, or closes where another attribute's value opens behind a ">", is no quote.
    Comments end at "-->", or, where that is missing, at ">"; "<" that starts nothing, or isn't closed, is text."""

    def __init__(self, source: str):
        self.source, self.at, self.missing, self.quotes = source, 0, {}, True

    def find(self, what: str, at: int) -> int:
        """As str.find; what isn't found is remembered, so the rest is searched for it once."""
        if self.missing.get(what, len(self.source) + 1) <= at:
            return -1
        found = self.source.find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def skip(self, name: str) -> bool:
        """Go behind the end tag of a raw element; False if there is none and the element is to be read like others."""
        if name not in self.missing:
            end = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*>", re.I).search(self.source, self.at)
            if end:
                self.at = end.end()
                return True
            self.missing[name] = self.at
        if name in UNREAD:
            self.at = len(self.source)
        return name in UNREAD

    def tag_end(self, at: int) -> int:
        """The place of the ">" of a tag whose attributes start here; some ">" follows. If all are in quotes, it is the first, and
        quotes say nothing from here on."""
        source, begin = self.source, at
        if plain := PLAIN.match(source, at):
            return plain.end() - 1
        while self.quotes and self.find(">", at) >= 0:
            edge = EDGE.search(source, at)
            i = edge.start()
            if edge[0] == ">":
                return i
            before = i - 1
            while before > begin and source[before].isspace():
                before -= 1
            at = i + 1
            if before >= begin and source[before] == "=":
                shut = self.find(edge[0], at)
                inside = self.find(">", at)
                if shut >= 0 and not (0 <= inside < shut and source[max(at, shut - 64) : shut].rstrip().endswith("=")):
                    at = shut + 1
        self.quotes = False
        return self.find(">", begin)

    def markup(self, at: int) -> tuple[int, str, str, str] | None:
        """The end, kind, name and attributes of what "<" starts here; no kind for comments; None if it is text."""
        source = self.source
        kind = source[at + 1 : at + 2]
        if kind == "!":
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
                if source.startswith(opening, at) and (end := self.find(closing, at + 2 if opening == "<!--" else at)) >= 0:
                    return end + 3, "", "", ""
        shut = self.find(">", at)
        if shut < 0:
            return None
        name = NAME.match(source, at + 2 if kind == "/" else at + 1)
        if name:
            end = self.tag_end(name.end())
            return end + 1, "end" if kind == "/" else "start", name[0].lower(), source[name.end() : end]
        return (shut + 1, "", "", "") if kind in "!?/" else None

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        text = self.at
        while True:
            less = self.find("<", self.at)
            found = self.markup(less) if less >= 0 else None
            if less >= 0 and found is None:
                self.at = less + 1
                continue
            stop = less if less >= 0 else len(self.source)
            if stop > text:
                yield "text", "", self.source[text:stop]
            if found is None:
                return
            self.at, kind, name, rest = found
            if kind:
                yield kind, name, rest  # the reader may skip() from here
            text = self.at


class Page:
    """A page's elements in document order: tags, attribute tokens, parents, and its text in pieces (element, text)."""

    def __init__(self, source: str):
        self.tag, self.tokens, self.parent, self.pieces, self.label = ["html"], [frozenset()], [-1], [], [None]
        stack, opened = [0], Counter({"html": 1})

        def drop(i: int) -> None:
            for e in stack[i:]:
                opened[self.tag[e]] -= 1
            del stack[i:]

        def close(names: set | frozenset, bounds: set | frozenset) -> None:
            if not any(opened[x] for x in names):
                return
            for i in range(len(stack) - 1, 0, -1):
                if self.tag[stack[i]] in names:
                    drop(i)
                    return
                if self.tag[stack[i]] in bounds:
                    return

        scanner = Scanner(source)
        for kind, name, rest in scanner:
            if kind == "text":
                self.pieces.append((stack[-1], rest))
            elif kind == "end":
                if opened[name]:
                    close({name}, frozenset() if name not in INLINE else CLOSES_P - {"p"})
            else:
                if name in CLOSES_P:
                    close({"p"}, {"button", "td", "th", "table"} | ({"article", "section", "div", "body"} if name != "p" else set()))
                if name in IMPLIED:
                    close(*IMPLIED[name])
                if name in ("html", "body") and len(stack) > 1:
                    continue
                self.tag.append(name)
                values = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest else {}
                self.tokens.append(frozenset(t for k in ("class", "id", "role", "itemprop", "aria-label") if k in values for t in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", values[k]).lower())))
                self.label.append(values.get("data-y"))
                self.parent.append(stack[-1])
                if name in VOID or rest.endswith("/") and any(opened[x] for x in FOREIGN):
                    if name in ("br", "hr", "img"):
                        self.pieces.append((stack[-1], " "))
                elif name not in RAW or not scanner.skip(name):
                    stack.append(len(self.tag) - 1)
                    opened[name] += 1

    def features(self) -> np.ndarray:
        n = len(self.tag)
        tag, parent = self.tag, np.array(self.parent)
        own, links, words, commas, first = (np.zeros(n) for _ in range(5))
        in_link = [False] * n
        depth = np.zeros(n)
        marks = np.zeros((n, 1 + len(BAD)))
        for i in range(n):
            p = parent[i]
            in_link[i] = tag[i] == "a" or p >= 0 and in_link[p]
            depth[i] = depth[p] + 1 if p >= 0 else 0
            if self.tokens[i]:
                marks[i] = [bool(self.tokens[i] & GOOD), *(bool(self.tokens[i] & s) for s in BAD.values())]
        seen = 0
        first[:] = -1
        for i, text in self.pieces:
            size = len(text.strip())
            own[i] += size
            words[i] += text.count(" ")
            commas[i] += text.count(",") + text.count(".")
            if in_link[i]:
                links[i] += size
            if size and first[i] < 0:
                first[i] = seen
            seen += size
        above = np.zeros((n, 1 + len(BAD)))
        zones = ("nav", "header", "footer", "aside", "form", "article", "main", "a")
        zone = np.zeros((n, len(zones)))
        total, link, tags, wordy, pause, paragraphs, below = own.copy(), links.copy(), np.ones(n), words.copy(), commas.copy(), np.array([t == "p" for t in tag], float), first.copy()
        children, order = np.zeros(n), np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            above[i] = np.maximum(above[p], marks[p])
            zone[i] = zone[p]
            if tag[i] in zones:
                zone[i, zones.index(tag[i])] = 1
            order[i] = children[p]
            children[p] += 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            for a in (total, link, tags, wordy, pause, paragraphs):
                a[p] += a[i]
            if below[i] >= 0 and (below[p] < 0 or below[i] < below[p]):
                below[p] = below[i]
        whole = max(total[0], 1)
        kin = np.maximum(parent, 0)
        kinds = np.zeros((n, len(TAGS) + 1))
        kinds[np.arange(n), [TAGS.index(t) if t in TAGS else len(TAGS) for t in tag]] = 1
        rest = np.stack([
            depth, np.log1p(total), np.log1p(own), link / np.maximum(total, 1), total / tags, np.log1p(tags), total / whole, wordy / np.maximum(total, 1), pause / np.maximum(total, 1), np.log1p(pause),
            np.log1p(paragraphs), children, order, order / np.maximum(children[kin], 1), total / np.maximum(total[kin], 1), np.maximum(below, 0) / whole, link[kin] / np.maximum(total[kin], 1), np.log1p(total[kin]), np.log1p(paragraphs[kin]),
            zone[:, 5] + zone[:, 6], zone[:, :5].max(axis=1), zone[:, 7],
        ], axis=1)
        return np.concatenate([kinds, marks, above, rest], axis=1)

    def text(self, score: np.ndarray) -> str:
        main = self.decode(score)
        out, block, line = [], None, []
        # the nearest element that isn't inline
        of = list(range(len(self.tag)))
        for i, tag in enumerate(self.tag):
            if tag in INLINE and i:
                of[i] = of[self.parent[i]]
        for i, text in self.pieces:
            if not main[i]:
                continue
            if of[i] != block:
                out.append("".join(line))
                block, line = of[i], []
            line.append(text)
        out.append("".join(line))
        return " ".join(" ".join(html.unescape(b) for b in out).split())

    def decode(self, score: np.ndarray) -> list[bool]:
        """Whether each element's own text is article, by the cheapest states of all subtrees."""
        n = len(self.tag)
        length = [0] * n
        for i, text in self.pieces:
            length[i] += len(text.strip())
        yes, no = np.logaddexp(0, -score), np.logaddexp(0, score)
        weight = np.minimum(np.array(length), 300) / 30 + 0.3
        as_main, as_rest = (yes * weight).tolist(), (no * weight).tolist()
        barred = [t in NEVER for t in self.tag]
        for i in range(n):
            if barred[i]:
                as_main[i] = float("inf")
        own_main, own_rest = as_main.copy(), as_rest.copy()
        mixed = [MIX + min(a, b) for a, b in zip(own_main, own_rest, strict=True)]
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            as_main[p] += as_main[i]
            as_rest[p] += as_rest[i]
            mixed[p] += min(as_main[i], as_rest[i], mixed[i])
        state = [""] * n
        for i in range(n):
            over = state[self.parent[i]] if i else "mixed"
            state[i] = over if over != "mixed" else min(("main", as_main[i]), ("rest", as_rest[i]), ("mixed", mixed[i]), key=lambda x: x[1])[0]
        return [s == "main" or s == "mixed" and a < b for s, a, b in zip(state, own_main, own_rest, strict=True)]


#: The price of a subtree that is neither all article nor all boilerplate.
MIX = 0.5
#: Pages that the generator lays out for training, and its seed.
TRAINING_PAGES, TRAINING_SEED = 260, 7


class Layout:
    """Random pages whose elements say in data-y whether they are article (1) or not (0)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.other = random.Random(seed + 1)  # of what noscript says, so that it may change without the rest of the pages
        self.syllables = [a + b for a in "b d f g k l m n p r s t v ch st".split() for b in "a e i o u an er in on al".split()]

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choices(self.syllables, k=r.randint(1, 3))) + ("," if r.random() < 0.08 else "." if r.random() < 0.06 else "") for _ in range(r.randint(low, high))]
        return " ".join(out).capitalize() + "."

    def said(self, low: int, high: int) -> str:
        """words(), drawn from the other numbers."""
        self.r, self.other = self.other, self.r
        try:
            return self.words(low, high)
        finally:
            self.r, self.other = self.other, self.r

    def el(self, tag: str, inside: str, y: int, tokens: str = "") -> str:
        if self.r.random() < 0.3:
            tokens = ""
        kind = self.r.choice(("class", "id"))
        return f'<{tag} data-y="{y}"' + (f' {kind}="{tokens}"' if tokens else "") + f">{inside}</{tag}>"

    def link(self) -> str:
        return self.el("a", self.words(1, 4), 0)

    def menu(self, name: str) -> str:
        items = "".join(self.el("li", self.link(), 0) for _ in range(self.r.randint(3, 9)))
        tag = self.r.choice(("nav", "div", "nav"))
        return self.el(tag, self.el("ul", items, 0), 0, name if tag == "div" else "")

    def box(self, name: str, tag: str = "div") -> str:
        r = self.r
        inside = "".join(self.el(r.choice(("p", "div", "span", "p")), self.words(3, 30) + (self.link() if r.random() < 0.4 else ""), 0) for _ in range(r.randint(1, 3))) if r.random() < 0.6 else self.words(3, 25)
        return f'<{tag} data-y="0" class="{name}">{inside}</{tag}>'

    def comments(self) -> str:
        r = self.r
        each = "".join(self.el(r.choice(("li", "div")), self.el("span", self.words(1, 2), 0, "author") + self.el("p", self.words(4, 60), 0), 0, r.choice(("comment", "reply", "comment-body"))) for _ in range(r.randint(1, 6)))
        return f'<{r.choice(("div", "section"))} data-y="0" {r.choice(("id", "class"))}="{r.choice(("comments", "comment-list", "disqus", "reader-comments", "discussion"))}">{self.el("h2", self.words(1, 3), 0)}{each}</div>'

    def page(self) -> str:
        r = self.r
        parts = [self.el("h1", self.words(3, 12), 1)] if r.random() < 0.85 else []
        if r.random() < 0.3:
            parts.append(self.el("p", self.words(2, 6), 1, "byline"))
        for _ in range(1 if r.random() < 0.15 else r.randint(1, 14)):
            kind = r.random()
            if kind < 0.74:
                inside = self.words(1, 6) if r.random() < 0.15 else self.words(8, 110)
                if r.random() < 0.2:
                    inside += f' <a data-y="1" href="x">{self.words(1, 3)}</a> {self.words(2, 10)}'
                parts.append(f'<p data-y="1">{"<b data-y=1>" if r.random() < 0.1 else ""}{inside}' + ("</p>" if r.random() < 0.8 else ""))
            elif kind < 0.8:
                parts.append(self.el("h2", self.words(2, 7), 1))
            elif kind < 0.85:
                parts.append(self.el("ul", "".join(self.el("li", self.words(3, 20), 1) for _ in range(r.randint(2, 6))), 1))
            elif kind < 0.89:
                parts.append(self.el("blockquote", self.el("p", self.words(8, 50), 1), 1))
            elif kind < 0.91:
                parts.append(self.el("table", "".join(f'<tr data-y="1"><td data-y="1">{self.words(1, 4)}</td><td data-y="1">{self.words(1, 6)}</td></tr>' for _ in range(3)), 1))
            elif kind < 0.93:
                parts.append(self.el("div", self.words(8, 90), 1))
            else:
                parts.append(self.box(r.choice(("ad", "advert", "ads promo", "related", "newsletter signup", "share social")), r.choice(("div", "aside"))))
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section", "td"))
        if self.other.random() < 0.2:
            parts.insert(self.other.randint(0, len(parts)), f'<noscript data-y="1"><p data-y="1">{self.said(5, 60)}</p></noscript>')
        body = "".join(parts)
        name = r.choice(("article", "content", "post", "entry-content", "story-body", "main-content", "")) if tag != "article" else ""
        main = f'<{tag} data-y="1"' + (f' class="{name}"' if name else "") + f">{body}</{tag}>"
        if tag == "td":
            main = f'<table data-y="1"><tr data-y="1">{main}</tr></table>'
        before = [self.menu(r.choice(("menu", "nav", "navbar", "navigation")))] if r.random() < 0.85 else []
        if r.random() < 0.4:
            before.insert(0, self.box(r.choice(("header", "masthead", "site-header", "top")), r.choice(("header", "div"))))
        if r.random() < 0.3:
            before.append(self.box(r.choice(("cookie-notice", "notice", "cookie consent", "alert"))))
        if r.random() < 0.55:
            before.append(self.box(r.choice(("ad", "ads", "advert", "banner-ad", "sponsored"))))
        if r.random() < 0.2:
            before.append(self.menu("breadcrumb"))
        after = []
        if r.random() < 0.35:
            after.append(self.comments())
        if r.random() < 0.4:
            after.append(self.box(r.choice(("sidebar", "related", "widget", "side")), r.choice(("aside", "div"))))
        if r.random() < 0.25:
            after.append(f'<form data-y="0">{self.words(2, 10)}<input name="q"><button data-y="0">{self.words(1, 2)}</button></form>')
        if r.random() < 0.25:
            after.append(self.box("ad"))
        if r.random() < 0.9:
            after.append(self.box(r.choice(("footer", "site-footer", "copyright", "legal")), r.choice(("footer", "footer", "div"))))
        if r.random() < 0.3:
            before, after = (before + after[:1], after[1:]) if r.random() < 0.3 else (before, after)
        if self.other.random() < 0.4:
            before.insert(self.other.randint(0, len(before)), f'<noscript data-y="0">{self.said(3, 25)}</noscript>')
        middle = f'<div data-y="1" class="{r.choice(("wrapper", "container", "page", ""))}">{main}</div>' if r.random() < 0.35 else main
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><script>var a=1;</script></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


@cache
def trained_model(pages: int = TRAINING_PAGES, seed: int = TRAINING_SEED) -> Boosted:
    layout = Layout(seed)
    rows, labels, weights = [], [], []
    for _ in range(pages):
        page = Page(layout.page())
        x = page.features()
        n = len(page.tag)
        size, main = np.zeros(n), np.zeros(n)
        label = [None] * n
        for i in range(n):
            label[i] = page.label[i] if page.label[i] is not None else label[page.parent[i]] if i else None
        for i, text in page.pieces:
            size[i] += len(text.strip())
            main[i] += len(text.strip()) * (label[i] == "1")
        for i in range(n - 1, 0, -1):
            size[page.parent[i]] += size[i]
            main[page.parent[i]] += main[i]
        keep = size > 0
        rows.append(x[keep])
        share = main[keep] / size[keep]
        labels.append((share > 0.5).astype(float))
        weights.append(np.abs(2 * share - 1) * (0.5 + np.log1p(size[keep])))
    return fit(np.concatenate(rows), np.concatenate(labels), np.concatenate(weights))


def main_texts(model: Boosted, pages: list[str]) -> list[str]:
    parsed = [Page(p) for p in pages]
    if not parsed:
        return []
    score = model.score(np.concatenate([p.features() for p in parsed]))
    ends = np.cumsum([len(p.tag) for p in parsed])
    return [p.text(score[e - len(p.tag) : e]) for p, e in zip(parsed, ends, strict=True)]


def _extracted(model: Boosted, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        pages = [x or "" for x in batch.column(2).to_pylist()]
        for at in range(0, len(pages), 64):
            texts += main_texts(model, pages[at : at + 64])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row (page_id, url, html)."""
    model = model or trained_model()
    bounded_batches(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(lambda b: _extracted(model, b), "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
