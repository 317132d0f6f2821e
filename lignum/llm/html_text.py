"""Main text of HTML pages by a tree-structured graphical model.

A page becomes a tree of its block elements. Each block is content or not: its own features (tag,
class words, link density, lengths) give one potential, and each parent and child share another, so
evidence spreads: a paragraph in a footer is judged with the footer. Sum-product messages go up from
the leaves and down from the root, which on a tree gives exact marginals; blocks whose marginal is
above one half are kept. Both steps run level by level over all trees of a batch at once.

The weights maximise the likelihood of labelled pages, whose gradient needs the same marginals. They
are of two kinds. A bounded sample of the pages at hand is labelled by its own structure: where a page
has just one ``article``, or one ``main``, that is content but for the menus, headers, footers, asides,
forms, notices, adverts and comments in it. Each such page also counts with these two tags hidden, so
that other evidence is weighed. Further pages are made here in general layouts, as a sample may lack
them or hold no labels: plain bodies, tables, bare divisions and named wrappers amid such other parts.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lignum.llm.common import map_batches, table

# Sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style head template noscript title svg math iframe object canvas audio video select textarea datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var".split()
)
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An element whose start ends an open one of these, up to one of the third.
ENDS_LIKE = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that get a feature of their own.
TAGS = "html body main article section div p h1 h2 h3 h4 ul ol li dl dd table tr td blockquote pre figure figcaption header footer nav aside form fieldset button menu address details".split()
#: Words in class, id and role that count for and against; a feature each, so training weighs them.
WORDS = (
    "article content post entry story main body text page prose "
    "nav menu footer header sidebar side ad ads advert advertisement banner cookie consent notice alert popup modal promo sponsor sponsored "
    "related share social comment comments reply respond login signup subscribe newsletter search breadcrumb breadcrumbs pagination pager widget tags meta "
    "copyright legal toolbar disqus recommended teaser byline hidden"
).split()
TAG_AT = {t: i for i, t in enumerate(TAGS)}
WORD_AT = {w: len(TAGS) + i for i, w in enumerate(WORDS)}
N_NUMERIC = 17
N_FEATURES = len(TAGS) + len(WORDS) + N_NUMERIC
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
#: Work on pages of so many characters at once.
BATCH_CHARS = 4_000_000
#: Levels of so few blocks are worked on one by one.
NARROW = 6
#: The model learns from so many sampled pages at most, of so many characters at most, and from so many made ones.
SAMPLE_PAGES, SAMPLE_CHARS, MADE_PAGES = 200, 65_536, 800
#: Parts of an article that aren't content, by tag and by class, id or role.
OUTSIDE_TAGS = frozenset("nav menu header footer aside form".split())
OUTSIDE_WORDS = frozenset("menu nav header footer sidebar notice ad ads advert advertisement comment comments".split())


class Tree(HTMLParser):
    """Block elements of a page and the text directly in each, in page order."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.depth, self.tags, self.words = [-1], [0], ["html"], [()]
        self.marks: list[str | None] = [None]
        #: First block after each block's last descendant.
        self.end = [0]
        #: Runs of text: block, text with single spaces, characters within links.
        self.run_block: list[int] = []
        self.run_text: list[str] = []
        self.run_links: list[int] = []
        self.now, self.pieces, self.now_links = -1, [], 0
        self.open: list[tuple[str, int]] = [("html", 0)]  # element, the block it lies in or is
        self.count: dict[str, int] = {"html": 1}
        self.unseen = self.links = 0
        self.feed(html)
        self.close()
        self._flush(-1)
        while len(self.open) > 1:
            self._pop()
        self.end[0] = len(self.parent)

    def _flush(self, block: int) -> None:
        """Ends the run of text at hand; the next one lies in ``block``."""
        if text := " ".join("".join(self.pieces).split()):
            self.run_block.append(self.now)
            self.run_text.append(text)
            self.run_links.append(self.now_links)
        self.now, self.pieces, self.now_links = block, [], 0

    def _pop(self) -> str:
        tag, block = self.open.pop()
        if tag not in INLINE and tag not in UNSEEN:
            self.end[block] = len(self.parent)
        self.count[tag] -= 1
        self.unseen -= tag in UNSEEN
        self.links -= tag == "a"
        return tag

    def _close(self, tags, stop=frozenset()) -> None:
        """Ends the innermost open element of ``tags``, and all in it, unless one of ``stop`` is nearer."""
        if not any(self.count.get(t) for t in tags):
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at][0] in tags:
                while len(self.open) > at:
                    self._pop()
                return
            if self.open[at][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.count.get(tag):
            return
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "button"})
        if tag in ENDS_LIKE:
            self._close(*ENDS_LIKE[tag])
        if tag == "body" or (tag not in UNSEEN and tag in ENDS_P):
            self._close({"head"})
        if tag == "a":
            self._close({"a"}, {"table", "td", "th"})
        block = self.open[-1][1]
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                self.handle_data(" " if tag != "wbr" else "")
            return
        if tag not in INLINE and tag not in UNSEEN:
            found = dict(attrs)
            self.parent.append(block)
            self.depth.append(self.depth[block] + 1)
            self.tags.append(tag)
            self.words.append(tuple(w.lower() for k in ("class", "id", "role") for w in SPLIT.split(found.get(k) or "") if w))
            self.marks.append(found.get("data-label"))
            self.end.append(0)
            block = len(self.parent) - 1
        self.open.append((tag, block))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "math"):
            self._close({tag})

    def handle_endtag(self, tag):
        if tag not in ("html", "body") and self.count.get(tag):
            self._close({tag}, () if tag not in INLINE else {"table", "td", "th", "article", "div", "section"})
        elif tag == "br":
            self.handle_data(" ")

    def handle_data(self, data):
        if self.unseen or not data:
            return
        block = self.open[-1][1]
        if self.now != block:
            if data.isspace():
                return
            self._flush(block)
        self.pieces.append(data)
        if self.links:
            self.now_links += len(data.strip())

    def blocks(self) -> Iterator[tuple[int, str, int]]:
        """(block, its text with single spaces, characters in links)."""
        return zip(self.run_block, self.run_text, self.run_links, strict=True)

    def made_labels(self) -> list[int]:
        """1 for content, by ``data-label`` of each block or else its parent's label."""
        own: list[int] = []
        for parent, mark in zip(self.parent, self.marks, strict=True):
            own.append(int(mark) if mark is not None else own[parent] if parent >= 0 else 0)
        return own

    def found_labels(self) -> list[int] | None:
        """1 for content, by the page's one ``article`` or else its one ``main``; None if it has neither."""
        for tag in ("article", "main"):
            if self.tags.count(tag) == 1:
                top = self.tags.index(tag)
                own = [0] * len(self.parent)
                for i in range(top, self.end[top]):
                    outside = self.tags[i] in OUTSIDE_TAGS or not OUTSIDE_WORDS.isdisjoint(self.words[i])
                    own[i] = int((i == top or own[self.parent[i]]) and (i == top or not outside))
                return own
        return None

    def hidden(self) -> Tree:
        """This page with ``article`` and ``main`` seen as plain divisions."""
        self.tags = ["div" if t in ("article", "main") else t for t in self.tags]
        return self


class Forest:
    """The trees of several pages, as arrays: parents, levels and features."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.parent) for t in trees]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        n = int(self.first[-1])
        self.parent, end, depth = (np.empty(n, dtype=np.int64) for _ in range(3))
        own, chars, links, stops, upper = (np.zeros(n) for _ in range(5))
        hot: list[tuple[int, int]] = []
        outside, inside = [], []
        for t, base in zip(trees, self.first, strict=False):
            m = len(t.parent)
            self.parent[base : base + m] = np.array(t.parent) + base
            self.parent[base] = -1
            end[base : base + m] = np.array(t.end) + base
            depth[base : base + m] = t.depth
            for i, (tag, words) in enumerate(zip(t.tags, t.words, strict=True)):
                if tag in OUTSIDE_TAGS or not OUTSIDE_WORDS.isdisjoint(words):
                    outside.append(base + i)
                elif tag in ("article", "main"):
                    inside.append(base + i)
                hot += [(base + i, at) for at in {TAG_AT.get(tag, -1), *(WORD_AT.get(w, -1) for w in words)} - {-1}]
            for b, text, linked in t.blocks():
                chars[base + b] += len(text)
                own[base + b] += text.count(" ") + 1
                links[base + b] += min(linked, len(text))
                stops[base + b] += text.count(". ") + text.count(", ") + (text[-1] in ".!?")
                upper[base + b] += text[:1].isupper()
        outside, inside = np.array(outside, dtype=np.int64), np.array(inside, dtype=np.int64)
        self.hot_row, self.hot_col = np.array(hot, dtype=np.int64).reshape(-1, 2).T
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []

        def below(x):
            """Sums over each block and all within it, which follow it in page order."""
            total = np.concatenate([[0], np.cumsum(x)])
            return total[end] - total[:-1]

        def within(marks):
            """Whether each block is or lies in a marked one."""
            change = np.bincount(marks, minlength=n + 1) - np.bincount(end[marks], minlength=n + 1)
            return np.cumsum(change)[:n] > 0

        under, under_links, blocks = below(chars), below(links), below(chars > 0)
        share = lambda a, b: a / np.maximum(b, 1)
        whole = np.repeat(under[self.first[:-1]], sizes) if n else under
        most = np.repeat(np.maximum.reduceat(chars, self.first[:-1]), sizes) if n else chars
        numeric = [
            np.ones(n), chars > 0, np.log1p(own) / 5, share(links, chars), np.minimum(share(stops, own), 0.3) * 3, own >= 20, own >= 60,
            np.log1p(under) / 8, share(under_links, under), share(under, whole), np.minimum(depth, 20) / 10, np.log1p(blocks) / 3,
            share(chars, most), np.log1p(whole) / 8, share(under, whole) > 0.8, within(outside), within(inside),
        ]
        self.numeric = np.stack([np.asarray(x, dtype=np.float64) for x in numeric], axis=1)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Each block's log potential of being content."""
        hot = np.bincount(self.hot_row, weights=weights[self.hot_col], minlength=len(self.parent))
        return self.numeric @ weights[-N_NUMERIC:] + hot

    def slope(self, rest: np.ndarray) -> np.ndarray:
        """Sums of ``rest`` over the blocks that have each feature, times its value."""
        return np.concatenate([np.bincount(self.hot_col, weights=rest[self.hot_row], minlength=N_FEATURES - N_NUMERIC), rest @ self.numeric])

    def marginals(self, weights: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(label) of each block, P(parent's label, own label) of each block with a parent, and log Z.

        ``edges`` holds log potentials of (parent's label, child's label).
        """
        own = np.zeros((len(self.parent), 2))
        own[:, 1] = self.scores(weights)
        up, message, down = own.copy(), np.zeros_like(own), np.zeros_like(own)
        (e00, e01), (e10, e11) = edges.tolist()
        for level in self.levels[:0:-1]:
            if len(level) <= NARROW:
                for i in level.tolist():
                    a, b = up[i].tolist()
                    x, y = _add(e00 + a, e01 + b), _add(e10 + a, e11 + b)
                    message[i] = x, y
                    up[self.parent[i]] += (x, y)
                continue
            message[level] = np.logaddexp(edges[None, :, 0] + up[level, None, 0], edges[None, :, 1] + up[level, None, 1])
            np.add.at(up, self.parent[level], message[level])
        for level in self.levels[1:]:
            if len(level) <= NARROW:
                for i in level.tolist():
                    a, b = (up[self.parent[i]] - message[i] + down[self.parent[i]]).tolist()
                    down[i] = _add(e00 + a, e10 + b), _add(e01 + a, e11 + b)
                continue
            p = self.parent[level]
            rest = up[p] - message[level] + down[p]
            down[level] = np.logaddexp(edges[None, 0, :] + rest[:, 0, None], edges[None, 1, :] + rest[:, 1, None])
        belief = up + down
        log_z = np.logaddexp(belief[:, 0], belief[:, 1])
        pairs = np.zeros((len(own), 2, 2))
        inner = np.flatnonzero(self.parent >= 0)
        if len(inner):
            p = self.parent[inner]
            rest = up[p] - message[inner] + down[p]
            joint = rest[:, :, None] + edges[None] + up[inner][:, None, :]
            pairs[inner] = np.exp(joint - log_z[inner][:, None, None])
        return np.exp(belief - log_z[:, None]), pairs, float(log_z[self.parent < 0].sum())


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def train(made: list[str], found: list[str] = (), rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and edge potentials that fit the labels of both kinds of pages.

    Elements of ``made`` carry ``data-label`` (1 content, 0 not; inherited). ``found`` are pages of the
    input; those whose structure gives no labels are left out.
    """
    trees = [Tree(p) for p in made]
    labels = [y for t in trees for y in t.made_labels()]
    for page in found:
        if (own := Tree(page).found_labels()) is not None:
            trees += [Tree(page), Tree(page).hidden()]
            labels += [*own, *own]
    forest, y = Forest(trees), np.array(labels)
    inner = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[inner]], y[inner]), 1)
    weights, edges = np.zeros(N_FEATURES), np.zeros((2, 2))
    square_w, square_e = np.full(N_FEATURES, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):  # ascent on the likelihood, a step size for each weight
        single, pairs, _ = forest.marginals(weights, edges)
        slope_w = forest.slope(y - single[:, 1]) / len(y) - decay * weights
        slope_e = (seen - pairs.sum(axis=0)) / len(y) - decay * edges
        square_w += slope_w**2
        square_e += slope_e**2
        weights = weights + rate * slope_w / np.sqrt(square_w)
        edges = edges + rate * slope_e / np.sqrt(square_e)
    return weights, edges


def labelled_pages(n: int, seed: int = 1) -> list[str]:
    """Pages made by rule: an article in one of many wrappers or in none, amid parts that aren't content."""
    draw = random.Random(seed)
    letters = ["aeiou", "bcdfghklmnprstvw"]

    def word():
        return "".join(draw.choice(letters[(i + draw.randint(0, 1)) % 2]) for i in range(draw.randint(2, 9)))

    def sentence(low=4, high=18):
        return " ".join(word() for _ in range(draw.randint(low, high))).capitalize() + draw.choice([".", ".", ".", "?", "!"])

    def prose(low=1, high=7):
        return " ".join(sentence() for _ in range(draw.randint(low, high)))

    def links(k, item="li"):
        return "".join(f"<{item}><a href='/{word()}'>{word().capitalize()}</a></{item}>" for _ in range(k))

    def paragraph():
        kind = draw.random()
        if kind < 0.12:
            return f"<h{(h := draw.randint(2, 3))}>{sentence(1, 6)}</h{h}>"
        if kind < 0.18:
            return "<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(draw.randint(2, 5))) + "</ul>"
        if kind < 0.23:
            return f"<blockquote><p>{prose(1, 3)}</p></blockquote>"
        if kind < 0.28:
            return f"<p><strong>{sentence()}</strong> {prose(1, 2)}</p>"
        if kind < 0.36:
            return f"<p>{sentence(1, 3)}</p>"
        if kind < 0.44:
            return f"<p>{prose(1, 2)} <a href='/x'>{word()} {word()}</a> {prose(1, 3)}</p>"
        if kind < 0.5:
            return f"<div>{prose(1, 4)}</div>"
        return f"<p>{prose()}</p>"

    def aside_of():
        """A part that isn't content, as often as not full of prose."""
        text = prose(1, draw.choice([1, 2, 4]))
        box = draw.choice(["div", "section", "aside"])
        return draw.choice(
            [
                lambda: f"<nav><ul>{links(draw.randint(2, 9))}</ul></nav>",
                lambda: f"<div class='{draw.choice(['nav', 'menu', 'main-menu', 'navbar', 'breadcrumbs'])}'>{links(draw.randint(2, 8), 'span')}</div>",
                lambda: f"<{box} class='{draw.choice(['ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo', 'advertisement'])}'>{draw.choice([text, f'<p>{text}</p>'])}</{box}>",
                lambda: f"<div id='{draw.choice(['cookie-notice', 'cookie', 'consent', 'banner', 'notice', 'alert', 'popup'])}'><p>{text}</p><button>{word()}</button></div>",
                lambda: f"<aside class='{draw.choice(['sidebar', 'widget', 'side', 'related'])}'><h3>{sentence(1, 3)}</h3>{draw.choice([f'<p>{text}</p>', f'<ul>{links(4)}</ul>'])}</aside>",
                lambda: f"<aside>{text}</aside>",
                lambda: f"<form action='/s'><label>{word()}</label><input name=q><button>{word()}</button><p>{sentence()}</p></form>",
                lambda: f"<{box} class='{draw.choice(['comments', 'comment-list', 'replies', 'disqus'])}'>{draw.choice(['', f'<h3>{word()}</h3>'])}" + draw.choice(["<div class='comment'><p>%s</p></div>", "<p>%s</p>", "<div><p>%s</p></div>"]) * (k := draw.randint(1, 5)) % tuple(prose(1, 3) for _ in range(k)) + f"</{box}>",
                lambda: f"<div class='{draw.choice(['share', 'social', 'newsletter', 'subscribe', 'login', 'pagination', 'tags', 'recommended'])}'>{draw.choice([text, f'<ul>{links(3)}</ul>'])}</div>",
            ]
        )()

    def marked(part):
        """``part`` of a plain body, labelled as content."""
        if "data-label" in part.partition(">")[0]:
            return part
        return part.replace(">", " data-label=1>", 1) if part.startswith("<") else f"<div data-label=1>{part}</div>"

    out = []
    for _ in range(n):
        body = [draw.choice(["<h1>%s</h1>", "<h1 class='title'>%s</h1>", "<h2>%s</h2>"]) % sentence(2, 8)] if draw.random() < 0.8 else []
        brief = draw.random() < 0.2
        for _ in range(1 if brief else draw.choice([1, 2, 4, 7, 12])):
            body.append(draw.choice(["<p>%s</p>", "<p>%s", "%s"]) % sentence(1, 14) if brief else paragraph())
            if draw.random() < 0.08:
                body.append(f"<div data-label=0>{aside_of()}</div>" if draw.random() < 0.3 else aside_of().replace(">", " data-label=0>", 1))
        inner = "".join(body)
        layout = draw.random()
        if layout < 0.3:  # no wrapper of the article's own: the body or the cell of a table
            part = lambda x: x.replace(">", " data-label=0>", 1)
            menu = part(f"<{(tag := draw.choice(['ul', 'div', 'p', 'nav']))}>{links(draw.randint(3, 8), 'li' if tag == 'ul' else 'span')}</{tag}>")
            foot = draw.choice(["", part(f"<footer>{prose(1, 2)}</footer>"), part(f"<div class='footer'>&copy; {sentence(2, 8)}</div>")])
            others = "".join(part(aside_of()) for _ in range(draw.choice([0, 0, 1, 2])))
            if layout < 0.2:
                wraps = [draw.choice(["div", "div", "center", "section"]) for _ in range(draw.choice([0, 0, 0, 1, 2, 4]))]
                single = [f"<p data-label=1>{prose(1, 9)}</p>", f"<div data-label=1>{prose(2, 9)}</div>"]
                inner = draw.choice(["".join(map(marked, body)), *single])
                inner = "".join(f"<{w}>" for w in wraps) + inner + "".join(f"</{w}>" for w in reversed(wraps))
                page = f"<body>{draw.choice(['', menu])}{inner}{others}{foot}</body>"
                if layout < 0.03:  # text of the body itself
                    page = f"<body data-label=1>{prose(2, 9)}<br><br>{prose(2, 9)}{others}{foot}</body>"
            else:
                row = draw.choice([f"<td>{menu}</td><td data-label=1>{inner}</td>", f"<td data-label=1>{inner}</td><td>{menu}{others}</td>", f"<td data-label=1>{inner}</td>"])
                page = f"<body>{draw.choice(['', menu])}<table><tr>{row}</tr></table>{foot}</body>"
            out.append(f"<html><head><title>{sentence(2, 6)}</title></head>{page}</html>")
            continue
        wrap = draw.choice(
            ["<article data-label=1>%s</article>"] * 4
            + ["<main data-label=1>%s</main>", "<main><article data-label=1>%s</article></main>", "<section class='post' data-label=1>%s</section>", "<div class='content'><div data-label=1>%s</div></div>"]
            + [f"<div {k}='{v}' data-label=1>%s</div>" for k, v in (("class", "article-body"), ("class", "entry-content"), ("id", "content"), ("class", "post-text"), ("id", "main"), ("class", "story"), ("role", "main"))]
            + ["<div data-label=1>%s</div>", "<div><div><div data-label=1>%s</div></div></div>", "<div id='wrap'><div class='c1' data-label=1>%s</div></div>"]
        )
        head = draw.choice(["", f"<header><p>{sentence(1, 5)}</p></header>", f"<header><h1>{word()}</h1><nav>{links(4, 'span')}</nav></header>", f"<div class='header'>{sentence(1, 6)}</div>", f"<nav><ul>{links(5)}</ul></nav>"])
        foot = draw.choice(["", f"<footer>&copy; {word()} &middot; {prose(1, 2)}</footer>", f"<footer><p>{prose(1, 3)}</p>{links(3, 'span')}</footer>", f"<div id='footer' class='copyright'>{prose(1, 2)}</div>"])
        before = "".join(aside_of() for _ in range(draw.choice([0, 1, 1, 2, 3])))
        after = "".join(aside_of() for _ in range(draw.choice([0, 0, 1, 2, 3])))
        out.append(f"<html><head><title>{sentence(2, 6)}</title></head><body>{head}{before}{wrap % inner}{after}{foot}</body></html>")
    return out


@cache
def default_model() -> tuple[np.ndarray, np.ndarray]:
    """The model of made pages alone."""
    return train(labelled_pages(MADE_PAGES))


def sample(pages: DataFrame) -> list[str]:
    """At most ``SAMPLE_PAGES`` pages of at most ``SAMPLE_CHARS`` characters, spread evenly by a hash of id and address."""
    share = min(1.0, 4 * SAMPLE_PAGES / max(pages.count(), 1))  # some are too long; few enough are left to sort
    key = F.xxhash64("page_id", "url")
    most = min(int(share * 2**64) - 2**63, 2**63 - 1)
    near = pages.select("html", key.alias("key")).filter((F.col("key") <= F.lit(most)) & F.col("html").isNotNull() & (F.length("html") <= SAMPLE_CHARS))
    return [r.html for r in near.orderBy("key", "html").limit(SAMPLE_PAGES).collect()]


def main_text(html: list[str], weights: np.ndarray, edges: np.ndarray) -> list[str]:
    """The main text of each page: blocks whose marginal is above one half, in page order."""
    trees = [Tree(h) for h in html]
    forest = Forest(trees)
    keep = forest.marginals(weights, edges)[0][:, 1] > 0.5
    return ["\n".join(text for b, text, _ in t.blocks() if keep[first + b]) for t, first in zip(trees, forest.first, strict=False)]


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    ``pages`` has ``page_id, url, html``; other columns are ignored. The model, unless given, learns from
    a ``sample`` of them and from made pages. Null or empty html, and a page without content, give an
    empty text. Repeated rows each give a row; an empty table gives none. A very long page is worked on
    whole, by one task, in time that grows with its length, however deep it is.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages(MADE_PAGES), sample(pages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            ids, urls, html = (batch[c].to_pylist() for c in ("page_id", "url", "html"))
            low = held = 0
            for i, h in enumerate([*html, None]):
                if i == len(html) or held + len(h or "") > BATCH_CHARS and i > low:
                    texts = main_text([x or "" for x in html[low:i]], *shared.value) if i > low else []
                    yield {"page_id": ids[low:i], "url": urls[low:i], "text": texts, "n_chars": [len(t) for t in texts]}
                    low, held = i, 0
                held += len(h or "")

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with the model trained here."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_text": op3_html_text}
ORACLE_SQL: dict[str, str] = {}
