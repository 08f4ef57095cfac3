"""Operator 7: main-text extraction by a tree-structured graphical model.

A page's block elements (and inline ones that carry a class, id or role) are the nodes of a tree. Each
node has a hidden state, main text or not. Its own potential comes from its tag, the words of its
class, id and role, its text's length, its share of link text and its punctuation; an edge's potential
says how likely parent and child share a state, by the child's tag. Messages pass once from the leaves
to the root and once back (sum-product), which gives each node's exact marginal; text belongs to the
page's main text if its node's marginal is at least one half.

The potentials are fitted, by exact likelihood, on labelled pages that `labelled_pages` writes from
templates of many layouts; nothing is learned from the pages to be extracted. Training takes a second
and happens on the driver, pages are then extracted in one map without a shuffle, each in time
proportional to its length.

White space and references are treated as the contract says; line breaks inside a block count as white
space. Scripts, styles, comments and the head never give text. A null, empty or textless page has the
empty text. Rows that repeat come back as often; columns other than the three named are not read.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline.llm.common import slices, struct, table

# Fixed lists of tags by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is none of the page's; of these, those that without an end tag take the rest of the page.
RAW = frozenset("script style textarea title iframe template select".split())
TO_THE_END = frozenset("script style textarea title".split())
#: Elements within a line of text. Formulas, drawings and what stands in for an object or a script are such.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object noscript math annotation mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics svg circle defs desc g line path polygon rect text tspan use".split())
GROUPS = {
    "main": "article main", "nav": "nav menu", "top": "header hgroup", "foot": "footer", "aside": "aside", "form": "form fieldset button dialog",
    "text": "p", "title": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl li dt dd", "box": "div section center", "cell": "table thead tbody tfoot tr td th caption",
    "quote": "blockquote pre figure figcaption address details summary", "page": "html body",
}
#: Words of classes, ids and roles that say something about a node.
NEGATIVE = "ad ads advert advertisement banner sponsor sponsored promo promotion nav navigation navbar menu sidebar side footer header masthead comment comments reply replies discussion disqus respond share sharing social cookie cookies notice consent gdpr popup modal overlay newsletter subscribe subscription signup related recommended widget breadcrumb breadcrumbs login search copyright legal toolbar pagination pager tags meta alert disclaimer skip complementary contentinfo".split()
POSITIVE = "article content post entry main body story text prose".split()
#: What an open element of the first kind is closed by.
CLOSES = {"li": ("li", frozenset("ul ol menu".split())), "dt": ("dt dd", frozenset(["dl"])), "dd": ("dt dd", frozenset(["dl"])), "tr": ("tr td th", frozenset("table thead tbody tfoot".split())), "td": ("td th", frozenset(["tr", "table"])), "th": ("td th", frozenset(["tr", "table"]))}

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)\Z""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
STOP = re.compile(r"[.!?;:](?:\s|$)")


class Page:
    """A page's nodes and runs of text. Node 0 is the page itself."""

    def __init__(self, source: str):
        self.tags, self.parents, self.words = ["html"], [-1], [()]
        self.lengths, self.links, self.stops = [0], [0], [0]
        #: (block number, node, text) in page order.
        self.runs: list[tuple[int, int, str]] = []
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the node that holds their text
        # How many of each kind are open at most, so that an end tag without a start is not looked for.
        count: dict[str, int] = {}
        block, at, link_depth = 0, 0, 0
        n, search = len(source), MARKUP.search
        while at <= n:
            m = search(source, at)
            end = m.start() if m else n
            if end > at:
                self._text(source[at:end], block, stack[-1][1], link_depth)
            if m is None:
                break
            at = m.end()
            closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6]) if m[5] else (m[7], m[8], m[9])
            if name is None:
                continue
            name = name.lower()
            if name == "br":
                self.runs.append((block, stack[-1][1], " "))
                continue
            if closing:
                if name not in INLINE:
                    block += 1
                for i in range(len(stack) - 1, 0, -1) if count.get(name) else ():
                    if stack[i][0] == name:
                        link_depth -= sum(1 for t, _ in stack[i:] if t == "a")
                        self._cut(stack, i, count)
                        break
                    if name in INLINE and stack[i][0] not in INLINE:
                        break  # a stray end of an inline element does not close blocks
                continue
            if name in RAW or name == "head":
                # Text up to the end tag is no text of the page.
                if not rest.endswith("/"):
                    found = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(source, at)
                    if name == "head":
                        found = found or re.compile(r"(?=<body\b)", re.I).search(source, at)
                    if found:
                        at = found.end()
                    elif name in TO_THE_END:
                        at = n + 1
                continue
            if name in VOID:
                if name == "hr":
                    block += 1
                continue
            if name not in INLINE:
                block += 1
                if name in ("html", "body") and count.get(name):
                    continue
                self._close_for(name, stack, count)
                # Inline elements that are open here end with the block that they stand in.
                while len(stack) > 1 and stack[-1][0] in INLINE:
                    self._cut(stack, len(stack) - 1, count)
                link_depth = 0
                words = self._attributes(rest)
            else:
                link_depth += name == "a"
                words = self._attributes(rest) if "=" in rest else ()
                if not words:
                    stack.append((name, stack[-1][1]))
                    count[name] = count.get(name, 0) + 1
                    continue
            self.tags.append(name)
            self.parents.append(stack[-1][1])
            self.words.append(words)
            self.lengths.append(0)
            self.links.append(0)
            self.stops.append(0)
            stack.append((name, len(self.tags) - 1))
            count[name] = count.get(name, 0) + 1

    @staticmethod
    def _cut(stack: list[tuple[str, int]], at: int, count: dict[str, int]) -> None:
        for name, _ in stack[at:]:
            count[name] -= 1
        del stack[at:]

    @classmethod
    def _close_for(cls, name: str, stack: list[tuple[str, int]], count: dict[str, int]) -> None:
        """Closes what the start of a block element ends: an open paragraph, an item of the same list."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == "p":
                cls._cut(stack, i, count)
                break
            if stack[i][0] not in INLINE:
                break
        if name in CLOSES:
            same, within = CLOSES[name]
            for i in range(len(stack) - 1, 0, -1) if any(count.get(t) for t in same.split()) else ():
                if stack[i][0] in same.split():
                    cls._cut(stack, i, count)
                    break
                if stack[i][0] in within:
                    break

    @staticmethod
    def _attributes(rest: str) -> tuple[str, ...]:
        if "=" not in rest:
            return ()
        return tuple(w.lower() for m in ATTRIBUTE.finditer(rest) for w in WORD.findall(m[2] or m[3] or m[4] or ""))

    def _text(self, raw: str, block: int, node: int, link_depth: int) -> None:
        text = html_lib.unescape(raw) if "&" in raw else raw
        self.runs.append((block, node, text))
        size = len(text) if not text.isspace() else 0
        self.lengths[node] += size
        if link_depth > 0:
            self.links[node] += size
        self.stops[node] += len(STOP.findall(text))

    def features(self) -> list[list[int]]:
        """The numbers of the features that each node has."""
        n = len(self.tags)
        lengths, links = self.lengths[:], self.links[:]
        for i in range(n - 1, 0, -1):
            lengths[self.parents[i]] += lengths[i]
            links[self.parents[i]] += links[i]
        out = []
        for i in range(n):
            size, share = lengths[i], links[i] / lengths[i] if lengths[i] else 0.0
            f = [GROUP_OF.get(self.tags[i], OTHER), LENGTH_AT + (0 if size == 0 else 1 if size < 25 else 2 if size < 100 else 3 if size < 400 else 4), SHARE_AT + (0 if share < 0.1 else 1 if share < 0.4 else 2 if share < 0.8 else 3), STOPS_AT + min(self.stops[i], 3), BIAS]
            f += {WORD_AT[w] for w in self.words[i] if w in WORD_AT}
            negative = not IS_NEGATIVE.isdisjoint(self.words[i])
            if self.words[i]:
                f.append(NAMED_NEGATIVE if negative else NAMED)
            if f[0] == MAIN and not negative:
                f.append(PLAIN_MAIN)
            out.append(f)
        return out


NAMES = list(GROUPS)
GROUP_OF = {t: i for i, g in enumerate(NAMES) for t in GROUPS[g].split()}
IS_NEGATIVE = frozenset(NEGATIVE)
OTHER, MAIN = len(NAMES), NAMES.index("main")
LENGTH_AT, SHARE_AT, STOPS_AT, BIAS, NAMED, NAMED_NEGATIVE, PLAIN_MAIN = OTHER + 1, OTHER + 6, OTHER + 10, OTHER + 14, OTHER + 15, OTHER + 16, OTHER + 17
WORD_AT = {w: OTHER + 18 + i for i, w in enumerate(NEGATIVE + POSITIVE)}
WIDTH = OTHER + 18 + len(WORD_AT)
EDGES = OTHER + 1


def marginals(page: Page, node_weight: list[float], agree: list[float]) -> list[float]:
    """Each node's probability of being main text. Potentials are exp(w) for the state 1 and
    exp(+-agree) for equal or different states of parent and child."""
    parents, n = page.parents, len(page.tags)
    own, near, far = [0.0] * n, [0.0] * n, [0.0] * n
    exp = np.exp
    odds = [max(-30.0, min(30.0, sum([node_weight[k] for k in f]))) for f in page.features()]
    for i in range(n):
        own[i] = float(exp(odds[i]))
        near[i] = float(exp(2 * agree[GROUP_OF.get(page.tags[i], OTHER)]))
    # Up: ratio of the evidence for state 1 to that for 0 in each subtree, and as its parent hears it.
    up, heard = own[:], far
    for i in range(n - 1, 0, -1):
        r, e = up[i], near[i]
        heard[i] = (1 + r * e) / (e + r)
        p = parents[i]
        up[p] = min(1e100, max(1e-100, up[p] * heard[i]))
    # Down: the same from everything outside the subtree.
    total = up[:]
    for i in range(1, n):
        r, e = total[parents[i]] / heard[i], near[i]
        total[i] = min(1e100, max(1e-100, up[i] * (1 + r * e) / (e + r)))
    return [x / (1 + x) for x in total]


def main_text(source: str | None, model: tuple[list[float], list[float]]) -> str:
    if not source:
        return ""
    page = Page(source)
    keep = [p >= 0.5 for p in marginals(page, *model)]
    blocks: dict[int, list[str]] = {}
    for block, node, text in page.runs:
        if keep[node]:
            blocks.setdefault(block, []).append(text)
    texts = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


# --- training ----------------------------------------------------------------------------------


def labelled_pages(count: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    """Pages made from templates, with the state of every node in order (node 0 being the page)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 9)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))

    style = [""]

    def sentences(n: int) -> str:
        text = " ".join(phrase(3, 14).capitalize() + rng.choice("...!?") for _ in range(n))
        return text.replace(" ", f"{style[0]} ") if style[0] else text

    def page() -> tuple[str, list[int]]:
        out, states, plain = [], [0], rng.choice([0, 0, 0.2, 0.6])
        # Some pages' words carry symbols, so that their sentences show no stops.
        style[0] = rng.choice(["###", " |", "***", "-"]) if rng.random() < 0.2 else ""

        def node(tag: str, state: int, inside, *words: str) -> None:
            """An element; inside is text or a function that adds more. Words are its class."""
            key = rng.choice(["class", "class", "id"])
            # Names that say nothing stand on anything, alone or beside those that do.
            if rng.random() < plain:
                words = (*words, *(word() for _ in range(rng.randint(1, 2))))
            attr = f' {key}="{rng.choice(" -").join(words)}"' if words else ""
            out.append(f"<{tag}{attr}>")
            states.append(state)
            if callable(inside):
                inside()
            else:
                out.append(inside)
            if tag not in ("p", "li", "td") or rng.random() < 0.85:
                out.append(f"</{tag}>")

        def links(low: int = 3, high: int = 8):
            def items():
                for _ in range(rng.randint(low, high)):
                    node("li", 0, f'<a href="/{word()}">{phrase(1, 3)}</a>')

            return lambda: node("ul", 0, items)

        def chrome(*names: str):
            """Something that is not main text, as an element with one of the names."""
            name = rng.choice(names)
            kind = rng.random()
            fill = links() if kind < 0.3 else (lambda: [node("p", 0, sentences(rng.randint(1, 3))) for _ in range(rng.randint(1, 3))]) if kind < 0.7 else sentences(rng.randint(1, 3))
            node(rng.choice(["div", "div", "section", "aside"]), 0, fill, name, *([word()] if rng.random() < 0.3 else []))

        def comments():
            def one():
                node("p", 0, sentences(rng.randint(1, 4)))

            def each():
                for _ in range(rng.randint(1, 5)):
                    node(rng.choice(["div", "li", "article"]), 0, one, rng.choice(["comment", "reply"]))

            node(rng.choice(["div", "section"]), 0, lambda: (node("h3", 0, phrase(1, 2)), each()), rng.choice(["comments", "discussion", "respond", "replies"]))

        def story():
            node(rng.choice(["h1", "h1", "h2"]), 1, phrase(1, 9))
            if rng.random() < 0.08:  # a junk page: many paragraphs of a word or two, or one of a huge length
                for _ in range(rng.randint(20, 120)):
                    node("p", 1, phrase(1, 2) + rng.choice(["", "."]))
            for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 8, 12])):
                r = rng.random()
                if r < 0.62:
                    text = sentences(rng.choice([1, 1, 2, 3, 4, 6, 20]))
                    node("p", 1, text if rng.random() < 0.7 else f"<b>{phrase(1, 4)}</b> {text} <a href='#'>{phrase(1, 3)}</a> {phrase(2, 6)}.")
                elif r < 0.68:
                    node("p", 1, f"<b>{phrase(1, 4)}.<br>")
                elif r < 0.74:
                    node(rng.choice(["h2", "h3"]), 1, phrase(1, 6))
                elif r < 0.80:
                    node(rng.choice(["ul", "ol"]), 1, lambda: [node("li", 1, phrase(1, 9)) for _ in range(rng.randint(1, 5))])
                elif r < 0.84:
                    node("blockquote", 1, lambda: node("p", 1, sentences(rng.randint(1, 3))))
                elif r < 0.87:
                    node("table", 1, lambda: [node("tr", 1, lambda: [node("td", 1, phrase(1, 3)) for _ in range(2)]) for _ in range(rng.randint(1, 3))])
                elif r < 0.89:
                    node("pre", 1, phrase(3, 12))
                elif r < 0.91:
                    node("div", 1, lambda: node("p", 1, sentences(2)))
                elif r < 0.94:
                    tag = rng.choice(["form", "form", "aside", "nav", "footer"])
                    node(tag, 0, links() if tag == "nav" else sentences(rng.randint(1, 2)) if rng.random() < 0.5 else f'{phrase(1, 3)} <input name="q"> <b>{phrase(1, 2)}</b>')
                else:
                    chrome("ad", "ads", "advert", "advertisement", "sponsor", "promo", "share", "social", "newsletter", "subscribe", "related", "banner")

        def top():
            if rng.random() < 0.8:
                node("nav", 0, links())
            if rng.random() < 0.5:
                node("header", 0, lambda: (node("p", 0, phrase(1, 5)), links()() if rng.random() < 0.4 else None))
            for names in (("cookie", "notice", "consent", "gdpr", "alert", "modal", "popup", "overlay"), ("ad", "ads", "banner", "advertisement", "sponsored", "promotion"), ("menu", "navigation", "navbar", "breadcrumb", "breadcrumbs", "toolbar", "skip"), ("header", "masthead", "search", "login", "signup", "legal")):
                if rng.random() < 0.4:
                    chrome(*names)
            if rng.random() < 0.3:
                node("form", 0, f'{phrase(1, 3)} <input name="q"> {phrase(1, 3)}')

        def side():
            if rng.random() < 0.4:
                node("aside", 0, lambda: (node("h3", 0, phrase(1, 3)), links()() if rng.random() < 0.5 else node("p", 0, sentences(2))))
            if rng.random() < 0.2:
                node("div", 0, lambda: (node(rng.choice(["h2", "h3", "h4"]), 0, phrase(1, 3)), links()()), word())
            if rng.random() < 0.4:
                chrome("sidebar", "widget", "side", "related", "recommended", "complementary", "tags", "subscription")

        def bottom():
            if rng.random() < 0.5:
                comments()
            if rng.random() < 0.3:
                chrome("related", "recommended", "share", "sharing", "pagination", "pager", "disqus", "disclaimer", "promo")
            if rng.random() < 0.85:
                node("footer", 0, phrase(2, 9) if rng.random() < 0.5 else lambda: node("p", 0, sentences(2)))
            elif rng.random() < 0.7:
                chrome("footer", "copyright", "contentinfo", "legal")

        def centre():
            kind = rng.random()
            if kind < 0.45:
                node("article", 1, story)
            elif kind < 0.6:
                node("main", 1, story)
            elif kind < 0.85:
                node(rng.choice(["div", "div", "section"]), 1, story, rng.choice(POSITIVE))
            else:
                node("div", 1, lambda: node(rng.choice(["div", "section"]), 1, story) if rng.random() < 0.5 else story())

        def table():
            """Menu and text side by side, as pages were laid out once."""
            menu = lambda: out.append("<br>".join(f'<a href="/{word()}">{phrase(1, 3)}</a>' for _ in range(rng.randint(3, 8))))
            node("table", 0, lambda: (node("tr", 0, lambda: node("td", 0, phrase(1, 4))) if rng.random() < 0.7 else None, node("tr", 0, lambda: (node("td", 0, menu), node("td", 1, story))), node("tr", 0, lambda: node("td", 0, phrase(3, 9) + ".")) if rng.random() < 0.7 else None))

        def body():
            if rng.random() < 0.1:
                return table()
            top()
            if rng.random() < 0.3:
                node("div", 0, lambda: (centre(), side()), rng.choice(["wrapper", "page", "container", "layout"]))
            else:
                side() if rng.random() < 0.3 else None
                centre()
                side()
            bottom()

        node("body", 0, body)
        return "<html><head><title>x</title></head>" + "".join(out) + "</html>", [0, *states]

    return [page() for _ in range(count)]


class Forest:
    """Many pages' nodes in arrays, so that messages of all nodes at a depth pass at once."""

    def __init__(self, pages: list[Page]):
        parents, depths, groups, features = [], [], [], []
        for page in pages:
            base = len(parents)
            for i, p in enumerate(page.parents):
                parents.append(base + p if p >= 0 else -1)
                depths.append(depths[base + p] + 1 if p >= 0 else 0)
            groups += [GROUP_OF.get(t, OTHER) for t in page.tags]
            features += page.features()
        self.parent, self.group, depth = np.array(parents), np.array(groups), np.array(depths)
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
        self.inner = self.parent >= 0
        self.x = np.zeros((len(parents), WIDTH))
        for i, f in enumerate(features):
            self.x[i, f] = 1

    def expect(self, w: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's marginal, and the expected agreement (-1 to 1) of each with its parent."""
        a = 2 * agree[self.group]
        up = np.clip(self.x @ w, -30, 30)
        heard = np.zeros(len(up))
        message = lambda r, e: np.logaddexp(0, r + e) - np.logaddexp(e, r)
        for level in reversed(self.levels):
            heard[level] = message(up[level], a[level])
            np.add.at(up, self.parent[level], heard[level])
        total, rest = up.copy(), np.zeros(len(up))
        for level in self.levels:
            rest[level] = total[self.parent[level]] - heard[level]
            total[level] = up[level] + message(rest[level], a[level])
        same, other = np.logaddexp(0, up + rest) + a, np.logaddexp(up, rest)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30))), np.tanh((same - other) / 2)


@cache
def fitted(count: int = 300, seed: int = 1, rounds: int = 400, rate: float = 0.1, decay: float = 1e-5) -> tuple[list[float], list[float]]:
    """Node weights and agreement by tag group: the most likely ones given the labelled pages, by gradient
    ascent on the exact likelihood, whose gradient is what the states show less what sum-product expects."""
    pages, states = [], []
    for source, labels in labelled_pages(count, seed):
        page = Page(source)
        if len(labels) != len(page.tags):
            raise ValueError("a template and the parser disagree")
        pages.append(page)
        states += labels
    forest, y = Forest(pages), np.array(states, dtype=float)
    inner, parent = forest.inner, forest.parent
    seen = np.where(inner, (2 * y - 1) * (2 * y[parent] - 1), 0)
    w, agree = np.zeros(WIDTH), np.full(EDGES, 0.5)
    value, speed, power = np.concatenate([w, agree]), np.zeros(WIDTH + EDGES), np.zeros(WIDTH + EDGES)
    for t in range(1, rounds + 1):
        p, e = forest.expect(value[:WIDTH], value[WIDTH:])
        edge = np.bincount(forest.group[inner], weights=(seen - e)[inner], minlength=EDGES)
        gradient = np.concatenate([forest.x.T @ (y - p), edge]) / len(y) - decay * value
        speed, power = 0.9 * speed + 0.1 * gradient, 0.99 * power + 0.01 * gradient**2
        value = value + rate * (speed / (1 - 0.9**t)) / (np.sqrt(power / (1 - 0.99**t)) + 1e-8)
    return value[:WIDTH].tolist(), np.clip(value[WIDTH:], -6, 6).tolist()


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text and n_chars of every page."""
    model = fitted()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            texts = [main_text(h, model) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    source = df.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string"))
    rest = struct(("text", T.StringType()), ("n_chars", T.LongType()))
    return source.mapInArrow(run, T.StructType([source.schema[0], source.schema[1], *rest.fields]))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
