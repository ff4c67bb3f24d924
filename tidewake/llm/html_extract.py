"""Main-text extraction by gradient-boosted trees over DOM nodes, decoded over the tree.

A tolerant parser builds block nodes. Each gets features: tag, depth, subtree text, link and form density, attribute words of its own
and of its ancestors, and how it compares with its siblings. Boosted trees, trained on generated pages whose main text is known, give
the log-odds that a node's subtree holds main text. Decoding takes the best labelling in which no node is kept under a dropped
ancestor: a node is kept if its own log-odds and the best of its subtree sum to more than zero. Kept nodes' own text is the result.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewake.llm import boosted_trees
from tidewake.llm._shared import text_slices

#: Where markup begins: a comment, a declaration, or a tag; and what matters within a tag.
_START = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_MARK = re.compile("[>\"']")
#: Elements whose content is no text of the page: the raw ones end with the page if they aren't closed, the boxed ones need their end tag.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "iframe", "textarea", "title")}
BOXED = frozenset("noscript template svg math object select canvas audio video".split())
_BOX_END = re.compile(rf"</({'|'.join(sorted(BOXED))})\s*>", re.I)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li legend main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends: open tags of the first set, unless one of the second lies between.
_ENDS = {
    "li": (("li", "p"), ("ul", "ol", "menu")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "p"), ("table",)), "td": (("td", "th", "p"), ("tr", "table")), "th": (("td", "th", "p"), ("tr", "table")),
}
_TAGS = ["p", "h1", "h2 h3 h4 h5 h6", "div", "section", "article main", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset search", "table tbody thead tfoot tr td th", "blockquote pre figure figcaption", "#text"]
_TAG_AT = {t: k for k, group in enumerate(_TAGS) for t in group.split()}
_WORDS = [
    "nav navigation navbar menu breadcrumb breadcrumbs pagination pager", "ad ads advert advertisement advertising sponsor sponsored promo promotion banner adsense",
    "sidebar side aside widget widgets related recommended recommendations popular trending more rail", "footer foot copyright legal bottom colophon",
    "header head masthead topbar top logo branding site", "comment comments disqus reply replies respond discussion thread reader",
    "cookie cookies consent gdpr notice popup modal overlay alert message", "form newsletter subscribe subscription signup login search contact",
    "share sharing social follow tags meta byline tools toolbar", "content article main post entry story body text page blog",
]
_WORD_AT = {w: k for k, group in enumerate(_WORDS) for w in group.split()}
_IN = ["nav", "footer", "aside", "form", "article", "main", "header", "li"]
_STATS = ["depth", "chars", "words", "links", "word_length", "stops", "commas", "paragraphs", "in_paragraphs", "of_page", "own", "children", "inputs", "siblings", "place", "same_tag", "sibling_chars", "sibling_links", "sibling_share", "long_text", "rights", "after_main"]
WIDTH = len(_STATS) + len(_TAGS) + 2 * len(_WORDS) + len(_IN)


class TagEnds:
    """Where tags of a page end: at the first ``>`` outside quotes, or, if quotes never close so that none follows, at the first one at all.

    Linear in the page, whatever stands in its tags: a quote that led nowhere once leads nowhere for every tag before it.
    """

    def __init__(self, source: str):
        self.source, self.nowhere = source, set()
        self.unclosed = {'"': len(source), "'": len(source)}  # from where on no such quote closes

    def after(self, start: int) -> int:
        opened, at = [], start
        while m := _MARK.search(self.source, at):
            at = m.start()
            if m[0] == ">":
                return at
            if at in self.nowhere:
                break
            opened.append(at)
            close = self.source.find(m[0], at + 1) if at < self.unclosed[m[0]] else -1
            if close < 0:
                self.unclosed[m[0]] = min(at, self.unclosed[m[0]])
                break
            at = close + 1
        self.nowhere.update(opened)
        return self.source.find(">", start)


class Page:
    """Block nodes of a page in document order: parent, tag, attribute words, and pieces of text (each of one node)."""

    def __init__(self, source: str | None):
        self.parent, self.tag, self.attributes = [-1], ["body"], [""]
        self.inputs, self.links, self.link_chars = [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []  # (node, text); a new piece starts at every block border
        self._parse(source or "")

    def _parse(self, source: str) -> None:
        """One pass: every tag and every search of the open elements takes constant time, but for the elements that it closes."""
        stack: list[tuple[str, int]] = []  # open tags with the block node that they are or lie in
        where: dict[str, list[int]] = defaultdict(list)  # places of each tag in the stack
        blocks: list[int] = []  # places of block elements in the stack
        node, at, links = 0, 0, 0
        run: list[str] = []
        linked, has_block = 0, {0}
        boxes: dict[str, list[int]] | None = None  # where end tags of boxed elements stop

        def flush() -> None:
            nonlocal linked
            if run:
                text = " ".join(html.unescape("".join(run)).split())
                if text:
                    at = node
                    if node in has_block:  # loose text beside blocks is judged by itself
                        at = add(node, "#text", "")
                    self.pieces.append((at, text))
                    self.link_chars[at] += linked
                run.clear()
                linked = 0

        def add(parent: int, tag: str, attributes: str) -> int:
            self.parent.append(parent)
            self.tag.append(tag)
            self.attributes.append(attributes)
            self.inputs.append(0)
            self.links.append(0)
            self.link_chars.append(0)
            has_block.add(parent)
            return len(self.tag) - 1

        def push(tag: str) -> None:
            where[tag].append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            stack.append((tag, node))

        def pop_to(k: int) -> None:
            nonlocal node, links
            if blocks and blocks[-1] >= k:
                flush()
            while len(stack) > k:
                tag = stack.pop()[0]
                where[tag].pop()
                links -= tag == "a"
            while blocks and blocks[-1] >= k:
                blocks.pop()
            node = stack[-1][1] if stack else 0

        stop = source.rfind(">") + 1  # behind it no tag is closed, so nothing is searched there but a comment
        ends_of = TagEnds(source)
        while m := _START.search(source, at, stop):
            if m.start() > at:
                text = source[at : m.start()]
                run.append(text)
                if links:
                    linked += len(text)
            if m[1]:
                close = source.find("-->", m.end())
                at = close + 3 if close >= 0 else len(source)
                continue
            close = source.find(">", m.end()) if m[2] else ends_of.after(m.end())
            at = close + 1
            if m[2]:
                continue
            tag, attributes = m[4].lower(), source[m.end() : close]
            if m[3]:
                k = where[tag][-1] if where.get(tag) else -1
                if k >= 0 and (tag in BLOCKS or not blocks or blocks[-1] < k):
                    pop_to(k)
                continue
            if tag in RAW:
                closed = RAW[tag].search(source, at)
                at = closed.end() if closed else len(source)
                continue
            if tag in BOXED:
                if tag in ("svg", "math") and attributes.endswith("/"):
                    continue
                if boxes is None:
                    boxes = defaultdict(list)
                    for end in _BOX_END.finditer(source):
                        boxes[end[1].lower()].append(end.end())
                ends = boxes.get(tag, [])
                k = bisect_right(ends, at)
                if k < len(ends):
                    at = ends[k]
                    continue
            if tag in BLOCKS:
                if tag in ("html", "body"):
                    flush()
                    continue
                if tag in _ENDS:
                    ended, until = _ENDS[tag]
                    j = max((where[t][-1] for t in until if where.get(t)), default=-1)
                    open_ = [where[t][k] for t in ended if where.get(t) and (k := bisect_right(where[t], j)) < len(where[t])]
                    if open_:
                        pop_to(min(open_))
                elif blocks and stack[blocks[-1]][0] == "p":
                    pop_to(blocks[-1])
                flush()
                new = add(node, tag, " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)).lower() if attributes else "")
                if tag != "hr":
                    node = new
                    push(tag)
            elif tag == "br":
                run.append(" ")
            elif tag in ("input", "button"):
                self.inputs[node] += 1
                if tag == "button":
                    push(tag)
            elif tag not in VOID and not attributes.endswith("/"):
                if tag == "a":
                    links += 1
                    self.links[node] += 1
                push(tag)
        if at < len(source):
            run.append(source[at:].partition("<!--")[0])
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        chars, words, stops, commas, long_, rights = (np.zeros(n) for _ in range(6))
        for k, text in self.pieces:
            chars[k] += len(text)
            w = text.count(" ") + 1
            words[k] += w
            stops[k] += text.count(".") + text.count("!") + text.count("?")
            commas[k] += text.count(",")
            long_[k] += w >= 15
            rights[k] = max(rights[k], "©" in text or "(c)" in text)
        own = chars.copy()
        is_p = np.array([t == "p" for t in self.tag], float)
        sums = np.stack([chars, words, stops, commas, long_, np.array(self.link_chars, float), np.array(self.inputs, float), is_p, is_p * chars], 1)
        depth = np.zeros(n)
        tags = np.zeros((n, len(_TAGS)))
        mine, above = np.zeros((n, len(_WORDS))), np.zeros((n, len(_WORDS)))
        inside = np.zeros((n, len(_IN)))
        for k, (t, a) in enumerate(zip(self.tag, self.attributes)):
            if t in _TAG_AT:
                tags[k, _TAG_AT[t]] = 1
            if a:
                for w in _WORD.findall(a):
                    if w in _WORD_AT:
                        mine[k, _WORD_AT[w]] = 1
            if k:
                up = parent[k]
                depth[k] = depth[up] + 1
                above[k] = np.maximum(above[up], mine[up])
                inside[k] = inside[up]
            if t in _IN:
                inside[k, _IN.index(t)] = 1
        for k in range(n - 1, 0, -1):
            sums[parent[k]] += sums[k]
        chars, words, stops, commas, long_, links, inputs, ps, in_p = sums.T
        children = np.bincount(parent[1:], minlength=n).astype(float) if n > 1 else np.zeros(n)
        density = links / np.maximum(1, chars)
        up = np.maximum(parent, 0)
        siblings = np.maximum(1, children[up])
        order = np.zeros(n)
        seen = np.zeros(n)
        same: dict[tuple[int, str], int] = {}
        for k in range(1, n):
            order[k] = seen[up[k]]
            seen[up[k]] += 1
            same[up[k], self.tag[k]] = same.get((up[k], self.tag[k]), 0) + 1
        same_tag = np.array([same.get((u, t), 1) for u, t in zip(up.tolist(), self.tag)], float)
        total_chars = np.bincount(up[1:], chars[1:], n) if n > 1 else np.zeros(n)
        total_links = np.bincount(up[1:], links[1:], n) if n > 1 else np.zeros(n)
        stats = [
            np.minimum(depth, 30), np.log1p(chars), np.log1p(words), np.minimum(1, density), np.minimum(20, chars / np.maximum(1, words)), stops / np.maximum(1, words), commas / np.maximum(1, words), np.log1p(ps), in_p / np.maximum(1, chars),
            chars / max(1, chars[0]), np.log1p(own), np.log1p(children), np.log1p(inputs), np.log1p(siblings), order / siblings, same_tag / siblings, np.log1p(total_chars[up] / siblings), total_links[up] / np.maximum(1, total_chars[up]), chars / np.maximum(1, total_chars[up]), np.log1p(long_),
            rights, np.concatenate([[0.0], np.cumsum(own)[:-1]]) / max(1.0, own.sum()),
        ]
        return np.concatenate([np.stack(stats, 1), tags, mine, above, inside], 1)

    def keep(self, log_odds: np.ndarray) -> np.ndarray:
        """The best labelling without a kept node under a dropped one; the root is kept."""
        gain = log_odds.copy()
        for k in range(len(gain) - 1, 0, -1):
            if gain[k] > 0:
                gain[self.parent[k]] += gain[k]
        kept = gain > 0
        kept[0] = True
        for k in range(1, len(kept)):
            kept[k] &= kept[self.parent[k]]
        return kept

    def text(self, kept: np.ndarray) -> str:
        return "\n\n".join(t for k, t in self.pieces if kept[k])


class _Writer:
    """Generated pages: known main blocks among menus, notices, adverts, side columns, forms, comments and footers."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: list[str] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = []
        for i in range(r.randint(low, high)):
            w = "".join(r.choice("aeioulnrstdhmcpäé") for _ in range(max(1, int(r.gauss(5.5, 2.5)))))
            out.append(w.capitalize() if not out or out[-1][-1] == "." else w)
            if r.random() < 0.11:
                out[-1] += r.choice(".,.,!?")
        return " ".join(out)

    def box(self, tag: str, names: str, inner: str, bare: float = 0.0) -> str:
        """A box with a telling tag or name; with probability ``bare`` one without either."""
        r = self.r
        if r.random() < bare:
            return f"<div>{inner}</div>" if r.random() < 0.7 else inner
        semantic = tag in ("nav", "footer", "aside", "form", "article", "main", "header", "section")
        if semantic and tag != "form" and r.random() < 0.35:
            tag, semantic = "div", False
        name = r.choice(names.split())
        attribute = "" if semantic and r.random() < 0.6 else f' {r.choice(["class", "class", "id"])}="{r.choice(["", "", "site-", "c-", "box "])}{name}{r.choice(["", "", "-1", " clearfix", "-wrap"])}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def links(self, low: int, high: int) -> str:
        r = self.r
        items = [f'<a href="/x">{self.words(1, 4)}</a>' for _ in range(r.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " ".join(items)

    def paragraph(self, text: str) -> str:
        r = self.r
        if r.random() < 0.25:
            text = f"<b>{text}"
            text += r.choice(["</b>", "", "<br>"])
        if r.random() < 0.15:
            text += f' <a href="/y">{self.words(1, 5)}</a>'
        return f"<p>{text}" + r.choice(["</p>"] * 5 + [""])

    def body(self) -> str:
        """Main blocks, marked in ``self.main`` by a sign that each of them holds."""
        r = self.r

        def mark(text: str) -> str:
            self.main.append(f"mmk{len(self.main)}x")
            return f"{self.main[-1]} {text}"

        out = [f"<h1>{mark(self.words(1, 12))}</h1>"] if r.random() < 0.85 else []
        if out and r.random() < 0.2:
            out = [f"<header>{out[0]}</header>"]
        sections = r.random() < 0.2
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            if sections and r.random() < 0.3:
                out.append("</section><section>")
            x = r.random()
            size = r.choice([(1, 4), (5, 20), (20, 80), (60, 250)])
            if x < 0.74:
                out.append(self.paragraph(mark(self.words(*size))))
            elif x < 0.80:
                level = r.randint(2, 4)
                out.append(f"<h{level}>{mark(self.words(2, 8))}</h{level}>")
            elif x < 0.86:
                out.append("<ul>" + "".join(f"<li>{mark(self.words(2, 25))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.90:
                out.append(f"<blockquote>{self.paragraph(mark(self.words(8, 50)))}</blockquote>")
            elif x < 0.93:
                out.append("<table>" + "".join(f"<tr><td>{mark(self.words(1, 6))}</td><td>{mark(self.words(1, 6))}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif x < 0.96:
                out.append(f"<div>{mark(self.words(20, 90))}</div>")
            elif x < 0.98:
                out.append(f"<pre>{mark(self.words(3, 30))}</pre>" if r.random() < 0.5 else f"<figure><figcaption>{mark(self.words(3, 14))}</figcaption></figure>")
            else:
                out.append(self.advert())
        if r.random() < 0.35:  # furniture within the text
            out.insert(r.randint(min(1, len(out)), len(out)), r.choice([self.advert, self.notice, self.newsletter, self.share, self.related])())
        inner = "".join(out)
        return f"<section>{inner}</section>" if sections else inner

    def field(self) -> str:
        return f'<label>{self.words(1, 3)}</label><input type="text"><button>{self.words(1, 2)}</button>'

    def notice(self) -> str:
        text = self.words(5, 50)
        return self.box("div", "cookie consent notice popup alert message banner", f"<p>{text}</p>" if self.r.random() < 0.6 else text) if self.r.random() < 0.7 else self.box("div", "cookie consent notice gdpr", f"<p>{text}</p><button>{self.words(1, 2)}</button>")

    def newsletter(self) -> str:
        return self.box("form", "newsletter subscribe signup contact form", f"<p>{self.words(3, 30)}</p>{self.field()}")

    def share(self) -> str:
        return self.box("div", "share social tags meta", self.links(2, 6))

    def related(self) -> str:
        return self.box("div", "related recommended more popular", f"<h3>{self.words(1, 4)}</h3>{self.links(3, 8)}")

    def comments(self) -> str:
        r = self.r
        tag, item = ("ol", "li") if r.random() < 0.4 else ("div", "div")
        name = lambda x: f' class="{x}"' if item == "div" or r.random() < 0.5 else ""
        said = "".join(f'<{item}{name(r.choice(["comment", "comment-body", "reply"]))}><b>{self.words(1, 2)}</b><p>{self.words(5, 120)}</p></{item}>' for _ in range(r.randint(1, 6)))
        if tag == "ol":
            said = f"<ol{name('commentlist')}>{said}</ol>"
        return self.box("section", "comments comment disqus discussion respond", (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.7 else "") + said + (f"<form>{self.field()}</form>" if r.random() < 0.5 else ""))

    def advert(self) -> str:
        return self.box(self.r.choice(["div", "div", "aside"]), "ad ads advert sponsored promo banner", self.r.choice([self.words(3, 40), f"<p>{self.words(3, 40)}</p>", f'<a href="/z">{self.words(2, 9)}</a>']))

    def page(self) -> str:
        r = self.r
        before = [
            lambda: self.box("nav", "nav menu navbar navigation top-menu", self.links(1, 14), bare=0.25), lambda: self.box("header", "header masthead topbar branding", f"<div>{self.words(1, 6)}</div>" + (self.links(2, 8) if r.random() < 0.5 else "")),
            self.advert, lambda: self.box("div", "breadcrumb breadcrumbs", self.links(2, 5), bare=0.1), self.notice, lambda: self.box("form", "search login form", self.field()),
        ]
        side = lambda: self.box("aside", "sidebar widget related rail", (f"<h3>{self.words(1, 4)}</h3>" if r.random() < 0.8 else "") + r.choice([self.links(3, 10), f"<p>{self.words(10, 80)}</p>", f"<p>{self.words(10, 40)}</p>{self.links(2, 5)}", self.words(8, 60)]))
        after = [side, self.comments, self.share, self.related, self.newsletter, self.advert]
        kind, text = r.random(), self.body()
        if kind < 0.60:
            article = self.box("article", "article post entry story content article-body post-content", text)
        elif kind < 0.72:
            article = text  # no box of its own
        elif kind < 0.82:
            article = f"<div>{text}</div>"
        elif kind < 0.94:
            article = self.box("main", "main content page body text", text)
        else:
            article = f"<table><tr><td>{self.links(2, 8)}</td><td>{text}</td></tr></table>"
        tail = [f() for f in r.sample(after, r.randint(0, 4))]
        if r.random() < 0.4 and tail:  # some furniture inside the main column
            article = self.box(r.choice(["main", "div"]), "main content page container", article + tail.pop(), bare=0.2)
        elif r.random() < 0.4:
            article = self.box(r.choice(["main", "div"]), "main content page container wrapper", article, bare=0.2)
        footer = self.box("footer", "footer foot colophon bottom", r.choice([f"&copy; {self.words(2, 14)}", f"<p>{self.words(4, 30)}</p>", self.links(2, 9), f"<p>{self.words(3, 10)}</p>{self.links(2, 6)}"]))
        if r.random() < 0.15:
            footer = r.choice([f"<hr><small>&copy; {self.words(1, 6)}</small>", f"<div>&copy; {self.words(1, 6)}</div>", f"<p><small>(c) {self.words(1, 6)}</small></p>"])
        parts = [*(f() for f in r.sample(before, r.randint(0, 5))), *([side()] if r.random() < 0.2 else []), article, *tail, footer if r.random() < 0.9 else ""]
        if r.random() < 0.3:
            k = r.randrange(len(parts))
            parts[k] = f"<div>{parts[k]}</div>"
        inner = "".join(parts)
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>" + (f'<div class="wrapper">{inner}</div>' if r.random() < 0.3 else inner) + "</body></html>"


def training_set(pages: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features of all nodes of generated pages, and whether their subtrees hold main text."""
    x, y = [], []
    for k in range(pages):
        writer = _Writer(seed * 1_000_003 + k)
        page = Page(writer.page())
        marks = set(writer.main)
        held = np.zeros(len(page.tag))
        for node, text in page.pieces:
            held[node] = max(held[node], any(w in marks for w in text.split()[:2]))
        for node in range(len(held) - 1, 0, -1):
            held[page.parent[node]] = max(held[page.parent[node]], held[node])
        x.append(page.features()[1:])
        y.append(held[1:])
    return np.concatenate(x), np.concatenate(y)


@lru_cache(maxsize=4)
def model(pages: int = 1000, seed: int = 11) -> boosted_trees.Trees:
    """Trained on ``pages`` generated pages: a fixed, small amount of work."""
    return boosted_trees.fit(*training_set(pages, seed))


def extract_texts(sources: list[str | None], trees: boosted_trees.Trees) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    scores = trees.score(np.concatenate([p.features() for p in pages]))
    out, at = [], 0
    for p in pages:
        out.append(p.text(p.keep(scores[at : at + len(p.tag)])))
        at += len(p.tag)
    return out


def extract(df: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``key``, ``url`` and ``text`` (main text, blocks joined by two line feeds; empty if none) of each page.

    A narrow operator: the trained trees (some kilobytes) go to the tasks with the function. Null and empty sources give an empty text;
    text without any tag is main text; unclosed tags, comments and scripts are ended as browsers end them. Equal rows each
    give a row; other columns are left out; an empty table gives an empty one. Pages of any length are parsed whole.
    """
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, source, 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(key), part.column(url), pa.array(extract_texts(part.column(source).to_pylist(), trees), pa.string())], [key, url, "text"])

    return df.select(key, url, source).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{url}` {df.schema[url].dataType.simpleString()}, text string")
