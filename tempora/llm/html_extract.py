"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed to a tree of block elements; each node is described by its tag, the tokens of its class, id and
role, its depth, the density of text, links and elements in its subtree, and its siblings. Boosted trees give
the probability that a node holds main text. Decoding takes the cheapest choice for the whole tree, in which a
dropped node drops its descendants, so that no kept node stands in a dropped one.

The trees are fitted here, on SAMPLE pages that sample_pages() builds with their main text known: menus, headers,
sidebars, notices, adverts, forms, comments and footers in many nestings. That bound is a parameter; the pages that are
extracted play no part in it.

Defined results: null or empty html gives an empty text and 0 characters; a page without blocks keeps all its text; unclosed, crossed and cut-off tags follow
the rules of block nesting; repeated rows get equal rows each; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SAMPLE = 1200
SEED = 11

#: Elements that break text into blocks; those whose content is no markup; those that stand among
#: inline text and get a node of their own; those without content. Maths is inline text as any unknown element is.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
EMBEDDED = frozenset("noscript template svg object canvas audio video button".split())
#: A page of these alone has no block to tell from another: all its text is main text.
BARE = frozenset({"html", "head", "body", "#text"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open one of these, up to the nearest of the elements after the bar.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SPACES = re.compile(r"[ \t\n\r\f\v ]+")
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?""", re.S)
_ATTR = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Attribute tokens by what they tell of a node.
TOKENS = {
    "content": "article content main post entry body story text prose page blog news",
    "menu": "nav menu menus navbar navigation breadcrumb breadcrumbs toc pagination pager tabs sitemap links",
    "head": "header head masthead top logo hero branding toolbar",
    "foot": "footer foot bottom copyright legal colophon credits",
    "side": "sidebar side aside related recommended recommendations widget widgets promo teaser popular trending rail more",
    "talk": "comment comments reply replies discussion disqus respond responses feedback thread reader readers",
    "ad": "ad ads advert adverts advertisement sponsor sponsored banner promotion adsense",
    "notice": "cookie cookies consent notice notices alert popup modal newsletter subscribe subscription gdpr overlay warning privacy dialog",
    "form": "form search login signup register input",
    "share": "share sharing social follow tags tag meta byline author date print",
}
_TOKEN = {w: i for i, (_, ws) in enumerate(TOKENS.items()) for w in ws.split()}
TAGS = {
    "article": 0, "main": 0, "section": 1, "div": 1, "body": 1, "html": 1, "center": 1, "p": 2, "blockquote": 2, "pre": 2, "h1": 3, "h2": 3, "h3": 3, "h4": 3, "h5": 3, "h6": 3, "hgroup": 3,
    "ul": 4, "ol": 4, "dl": 4, "menu": 4, "li": 5, "dd": 5, "dt": 5, "nav": 6, "header": 7, "footer": 8, "aside": 9, "form": 10, "fieldset": 10, "select": 10, "option": 10, "search": 10, "dialog": 11, "table": 12, "tr": 12, "td": 12, "th": 12,
    "tbody": 12, "thead": 12, "tfoot": 12, "figure": 13, "figcaption": 13, "head": 14, "#text": 15,
}
N_TAGS, N_TOKENS = 17, len(TOKENS)


class Page:
    """A tree of block elements in page order: for each node its parent, tag, attribute tokens and own runs of text."""

    __slots__ = ("parent", "tag", "marks", "runs", "links")

    def __init__(self, source: str):
        self.parent, self.tag, self.marks = [-1], ["html"], [0]
        self.runs: list[tuple[int, str]] = []
        self.links: list[int] = []
        self._parse(source)

    def _open(self, parent: int, tag: str, attrs: str) -> int:
        marks = 0
        if attrs and "=" in attrs:
            for name, *values in _ATTR.findall(attrs):
                for word in _WORD.findall("".join(values)):
                    at = _TOKEN.get(word.lower())
                    if at is not None:
                        marks |= 1 << at
        self.parent.append(parent)
        self.tag.append(tag)
        self.marks.append(marks)
        return len(self.tag) - 1

    def _parse(self, source: str) -> None:
        stack, body = [0], False
        places: dict[str, list[int]] = {}  # of each tag the places in the stack where it is open, so that no tag searches the stack
        held: list[str] = []
        linked, in_link, at, size = 0, False, 0, len(source)

        def last(tags: Iterable[str]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def shut(k: int) -> None:
            for node in stack[k:]:
                places[self.tag[node]].pop()
            del stack[k:]

        def flush() -> None:
            nonlocal linked
            text = SPACES.sub(" ", entities.unescape("".join(held))).strip(" ")
            if text:
                self.runs.append((stack[-1], text))
                self.links.append(min(linked, len(text)))
            held.clear()
            linked = 0

        while at < size:
            m = _TAG.search(source, at)
            if m is None:
                held.append(source[at:])
                break
            if m.start() > at:
                held.append(source[at : m.start()])
                if in_link:
                    linked += m.start() - at
            at = m.end()
            close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            tag = name.lower()
            if tag in RAW:
                if not close and not (attrs or "").endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    at = end.end() if end else size
            elif tag == "a":
                in_link = not close
            elif tag == "br":
                held.append(" ")
            elif tag in BLOCKS or tag in EMBEDDED:
                inner = tag in EMBEDDED
                if inner and not close and (attrs or "").endswith("/"):
                    continue
                flush()
                in_link = in_link and inner
                if tag in ("html", "body") and not close and (tag == "html" or body):
                    continue
                if close:
                    if k := last((tag,)):
                        shut(k)
                    continue
                if tag == "hr":
                    continue
                if self.tag[stack[-1]] == "p" and not inner:
                    shut(len(stack) - 1)
                if tag in CLOSES:
                    which, until = CLOSES[tag]
                    if (k := last(which)) > last(until):
                        shut(k)
                body = body or tag == "body"
                places.setdefault(tag, []).append(len(stack))
                stack.append(self._open(stack[-1], tag, attrs))
        flush()
        # A run beside block children becomes a node of its own, which can be dropped without them; so does one in no
        # block but the page, which is never dropped itself.
        parents = set(self.parent)
        for i, (node, text) in enumerate(self.runs):
            if node in parents or node == 0:
                self.runs[i] = (self._open(node, "#text", ""), text)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        text, links, kids, nodes, paras, first, depth = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n, [0] * n
        for (node, run), linked in zip(self.runs, self.links, strict=True):
            text[node] += len(run)
            links[node] += linked
        order = sorted(range(1, n), key=lambda i: -self._depth(i, depth))
        same: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            first[i] = kids[parent[i]]
            kids[parent[i]] += 1
            same[parent[i], self.tag[i]] = same.get((parent[i], self.tag[i]), 0) + 1
        for i in order:
            p = parent[i]
            text[p] += text[i]
            links[p] += links[i]
            nodes[p] += nodes[i]
            paras[p] += paras[i] + (self.tag[i] == "p")
        total = text[0] or 1
        out = np.zeros((n, FEATURES), dtype=np.float32)
        above = [0] * n
        for i in range(n):
            p = max(0, parent[i])
            k = TAGS.get(self.tag[i], 16)
            above[i] = above[p] | self.marks[p] | (1 << (10 + TAGS.get(self.tag[p], 16)) if i else 0)
            out[i, :11] = (math.log1p(text[i]), links[i] / (text[i] or 1), text[i] / nodes[i], depth[i], kids[i], nodes[i], paras[i], first[i], kids[p] if i else 0, same.get((p, self.tag[i]), 1) / (kids[p] or 1), text[i] / total)
            out[i, 11] = text[i] / (text[p] or 1)
            out[i, 12 + k] = 1
            m, a = self.marks[i], above[i]
            for b in range(N_TOKENS):
                if m >> b & 1:
                    out[i, 12 + N_TAGS + b] = 1
                if a >> b & 1:
                    out[i, 12 + N_TAGS + N_TOKENS + b] = 1
            if a >> 10 & 1:
                out[i, 12 + N_TAGS + 2 * N_TOKENS] = 1
        return out

    def _depth(self, i: int, depth: list[int]) -> int:
        p = self.parent[i]
        depth[i] = depth[p] + 1
        return depth[i]

    def decode(self, keep: np.ndarray) -> str:
        """The blocks of the cheapest consistent choice, given each node's probability of main text."""
        n = len(self.tag)
        p = np.clip(keep, 1e-6, 1 - 1e-6)
        drop, stay = (-np.log1p(-p)).tolist(), (-np.log(p)).tolist()
        dropped, best = drop[:], [0.0] * n
        order = sorted(range(1, n), key=lambda i: -self._depth(i, depth)) if (depth := [0] * n) else []
        chosen = [False] * n
        for i in [*order, 0]:
            kept = stay[i] + best[i]
            chosen[i] = i == 0 or kept < dropped[i]
            if i:
                q = self.parent[i]
                dropped[q] += dropped[i]
                best[q] += min(kept, dropped[i])
        alive = [False] * n
        alive[0] = True
        if not set(self.tag) - BARE:
            chosen = [True] * n
        for i in range(1, n):
            alive[i] = chosen[i] and alive[self.parent[i]]
        return "\n".join(text for node, text in self.runs if alive[node] and node)


FEATURES = 12 + N_TAGS + 2 * N_TOKENS + 1


class Boosted:
    """Gradient-boosted regression trees for a logistic loss, over quantile bins of the features."""

    def __init__(self, rounds: int = 50, depth: int = 5, rate: float = 0.3, bins: int = 24, least: int = 12):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        # Features of two values are summed by a product, the others by bin.
        many = [j for j in range(x.shape[1]) if ((x[:, j] != 0) & (x[:, j] != 1)).any()]
        flags = [j for j in range(x.shape[1]) if j not in many]
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if j in many else np.array([0.0]) for j, c in enumerate(x.T)]
        is_set = np.ascontiguousarray(x[:, flags], dtype=np.float64)
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
        width = max(map(len, cuts)) + 1
        self.start = float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
        score = np.full(len(y), self.start)
        n_features = x.shape[1]
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size, dtype=np.float32), np.zeros(size)
            at = np.zeros(len(y), dtype=np.int64)
            for level in range(self.depth + 1):
                begin = 2**level - 1
                for node in range(begin, 2 * begin + 1):
                    rows = np.flatnonzero(at == node)
                    if not len(rows):
                        continue
                    g, h = grad[rows].sum(), hess[rows].sum()
                    value[node] = self.rate * g / (h + 1.0)
                    if level == self.depth or len(rows) < 2 * self.least:
                        continue
                    flat = (binned[rows][:, many] + np.arange(len(many)) * width).ravel()
                    gl, hl, nl = (np.zeros((n_features, width - 1)) for _ in range(3))
                    for left, w in ((gl, grad[rows]), (hl, hess[rows]), (nl, np.ones(len(rows)))):
                        left[many] = np.bincount(flat, np.repeat(w, len(many)), len(many) * width).reshape(len(many), width).cumsum(axis=1)[:, :-1]
                        left[flags] = (w.sum() - w @ is_set[rows])[:, None]
                    gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                        continue
                    feature[node], cut[node] = f, cuts[f][b]
                    at[rows] = 2 * node + 1 + (binned[rows, f] > b)
            self.trees.append((feature, cut, value))
            score += self._leaf(x, self.trees[-1])
        return self

    def _leaf(self, x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]))
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self._leaf(x, tree)
        return 1 / (1 + np.exp(-score))


#: Marks in the sample's text runs, by which labels are read off the parsed tree.
_MAIN, _REST = "\u0001", "\u0002"


def sample_pages(n: int = SAMPLE, seed: int = SEED) -> Iterator[str]:
    """Pages with every run of main text marked by \\u0001 and every other run by \\u0002."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(r.randint(lo, hi)))

    def rest(lo: int, hi: int) -> str:
        return _REST + words(lo, hi)

    def named(kind: str) -> str:
        word = r.choice(TOKENS[kind].split())
        shape = r.choice(['class="{}"', 'id="{}"', 'class="{}-box"', 'class="site-{}"', "class='wrap {}'", 'class="{}__inner"'])
        return " " + shape.format(word)

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{rest(1, 4)}</a></li>' for _ in range(n))

    def menu() -> str:
        inner = f"<ul>{links(r.randint(2, 12))}</ul>"
        return r.choice([f"<nav>{inner}</nav>", f"<div{named('menu')}>{inner}</div>", f"<ul{named('menu')}>{links(r.randint(3, 9))}</ul>", f"<nav{named('menu')}>{inner}</nav>"])

    def advert() -> str:
        body = r.choice([rest(3, 25), f"<p>{rest(5, 40)}</p>", f'<a href="/b">{rest(2, 12)}</a>'])
        return r.choice([f'<div class="ad">{body}</div>', f"<div{named('ad')}>{body}</div>", f"<aside{named('ad')}>{body}</aside>", f"<section{named('ad')}>{body}</section>"])

    def notice() -> str:
        body = f"<p>{rest(6, 45)}</p>" + r.choice(["", f"<button>{rest(1, 2)}</button>", f'<a href="/p">{rest(1, 3)}</a>'])
        return r.choice([f"<div{named('notice')}>{body}</div>", f"<section{named('notice')}>{body}</section>", f"<dialog>{body}</dialog>", f'<div role="dialog"{named("notice")}>{body}</div>'])

    def side() -> str:
        body = r.choice([f"<h3>{rest(1, 4)}</h3><ul>{links(r.randint(2, 8))}</ul>", f"<h2>{rest(1, 5)}</h2><p>{rest(10, 60)}</p>", "".join(f'<div><a href="/r">{rest(3, 9)}</a><p>{rest(5, 30)}</p></div>' for _ in range(r.randint(1, 5)))])
        return r.choice([f"<aside>{body}</aside>", f"<aside{named('side')}>{body}</aside>", f"<div{named('side')}>{body}</div>", f"<section{named('side')}>{body}</section>"])

    def comments() -> str:
        one = lambda: r.choice(["<li{}>{}</li>", "<div{}>{}</div>", "<article{}>{}</article>"]).format(r.choice(["", named("talk")]), f"<p>{rest(3, 60)}</p>" * r.randint(1, 2))
        body = f"<h3>{rest(1, 4)}</h3>" + "".join(one() for _ in range(r.randint(1, 8)))
        return r.choice([f"<section{named('talk')}>{body}</section>", f"<div{named('talk')}>{body}</div>", f"<ol{named('talk')}>{body}</ol>"])

    def form() -> str:
        body = f"<label>{rest(1, 4)}</label><input name='q'>" + r.choice(["", f"<p>{rest(4, 20)}</p>", f"<select><option>{rest(1, 2)}<option>{rest(1, 2)}</select>"])
        return r.choice([f"<form>{body}</form>", f"<form{named('form')}>{body}</form>", f"<div{named('form')}><form>{body}</form></div>"])

    def header() -> str:
        body = r.choice([rest(1, 6), f"<h1>{rest(1, 4)}</h1>", f"<p>{rest(2, 10)}</p>"]) + r.choice(["", menu()])
        return r.choice([f"<header>{body}</header>", f"<div{named('head')}>{body}</div>", f"<header{named('head')}>{body}</header>"])

    def footer() -> str:
        body = r.choice([f"&copy; {rest(2, 14)}", f"<p>{rest(3, 40)}</p>", f"<p>{rest(3, 20)}</p><ul>{links(r.randint(1, 6))}</ul>"])
        return r.choice([f"<footer>{body}</footer>", f"<footer{named('foot')}>{body}</footer>", f"<div{named('foot')}>{body}</div>"])

    def share() -> str:
        return r.choice([f"<div{named('share')}>{rest(1, 6)}</div>", f"<ul{named('share')}>{links(r.randint(2, 5))}</ul>", f"<p{named('share')}>{rest(1, 8)}</p>"])

    def main(lo: int, hi: int) -> str:
        text = _MAIN + words(lo, hi)
        return r.choice([text, text, text, f"<b>{text}<br>", f"{text} <em>{words(1, 4)}</em> {words(1, 8)}", f'{text} <a href="/in">{words(1, 4)}</a> {words(1, 9)}'])

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.74:
            return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}"]).format(main(1, r.choice([2, 4, 12, 60, 200])))
        if kind < 0.8:
            return f"<{(h := r.choice(['h2', 'h3', 'h4']))}>{main(1, 8)}</{h}>"
        if kind < 0.86:
            return f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{main(1, 25)}</li>" for _ in range(r.randint(1, 7))) + f"</{t}>"
        if kind < 0.9:
            return f"<blockquote>{r.choice(['{}', '<p>{}</p>']).format(main(3, 50))}</blockquote>"
        if kind < 0.93:
            return f"<pre>{main(2, 30)}</pre>"
        if kind < 0.96:
            return f"<figure><img src='i.png'><figcaption>{main(2, 14)}</figcaption></figure>"
        return "<table>" + "".join("<tr>" + "".join(f"<td>{main(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 5))) + "</table>"

    def article() -> str:
        parts = [paragraph() for _ in range(r.choice([1, 1, 1, 2, 3, 6, 12, 25]))]
        parts = r.choice([parts, parts, [_MAIN + words(5, 60), *parts] if r.random() < 0.3 else parts])
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            parts.insert(r.randint(0, len(parts)), r.choice([advert, share, side, form, notice, menu])())
        title = r.choice([f"<h1>{main(1, 14)}</h1>", f"<h1>{main(1, 14)}</h1>", f"<h2>{main(1, 10)}</h2>", f"<header><h1>{main(1, 12)}</h1></header>", ""])
        body = title + "".join(parts)
        if r.random() < 0.15:
            body += comments()
        shape = r.random()
        if shape < 0.5:
            return r.choice([f"<article>{body}</article>", f"<article{named('content')}>{body}</article>", f"<main><article>{body}</article></main>"])
        if shape < 0.7:
            return r.choice([f"<main>{body}</main>", f"<main{named('content')}><div>{body}</div></main>", f'<div role="main">{body}</div>'])
        if shape < 0.95:
            return r.choice([f"<div{named('content')}>{body}</div>", f"<div{named('content')}><div{named('content')}>{body}</div></div>", f"<section{named('content')}>{body}</section>"])
        return f"<div>{body}</div>"

    for _ in range(n):
        before = [f() for f in (header, menu, notice, advert) if r.random() < 0.55]
        after = [f() for f in (advert, side, comments, form, notice, share) if r.random() < 0.3] + ([footer()] if r.random() < 0.85 else [])
        if r.random() < 0.3:
            r.shuffle(before)
        if r.random() < 0.2:
            before.append(side())
        middle = article()
        if r.random() < 0.3:
            middle = f"<div{r.choice(['', ' class=\"wrapper\"', ' id=\"page\"'])}>{middle}{r.choice(['', side(), comments()])}</div>"
        end = r.choice(["</body></html>", "</body></html>", ""])
        yield f"<!DOCTYPE html><html><head><title>{rest(1, 9)}</title><style>p{{margin:0}}</style></head><body>{''.join(before)}{middle}{''.join(after)}{end}"


def labelled(source: str) -> tuple[Page, list[bool], str]:
    """A sample page without its marks, for each node whether main text is in it, and that text."""
    page = Page(source)
    main = [False] * len(page.tag)
    wanted = []
    for i, (node, text) in enumerate(page.runs):
        clean = text.replace(_MAIN, "").replace(_REST, "").strip(" ")
        if _MAIN in text:
            wanted.append(clean)
            at = node
            while at >= 0 and not main[at]:
                main[at] = True
                at = page.parent[at]
        page.runs[i] = (node, clean)
    return page, main, "\n".join(wanted)


@functools.lru_cache(maxsize=2)
def train(n: int = SAMPLE, seed: int = SEED) -> Boosted:
    x, y = [], []
    for source in sample_pages(n, seed):
        page, main, _ = labelled(source)
        x.append(page.features())
        y.append(np.array(main, dtype=float))
    return Boosted().fit(np.concatenate(x), np.concatenate(y))


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    fitted = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some hundred pages at a time, for the trees run over all their nodes at once.
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                trees = [Page(h or "") for h in part.column("html").to_pylist()]
                features = [t.features() for t in trees]
                keep = fitted.predict(np.concatenate(features))
                ends = np.cumsum([len(f) for f in features])
                texts = [t.decode(k) for t, k in zip(trees, np.split(keep, ends[:-1]), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
