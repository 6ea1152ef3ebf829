"""HTML extraction by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, each
with the path of open elements. A bidirectional LSTM in numpy reads the blocks
of a page in order; a block's input is the sum of vectors of its path's hashed
tags, classes and ids, the mean of vectors of its hashed words, and a few
measures (length, share of links, punctuation). Each block is classified main
or not with the context of the whole page.

No page comes with labels, so the network learns from pages that ``example``
writes by rule with known labels: layouts with menus, headers, footers,
sidebars, notices, adverts, forms, comments and articles in many mark-ups, of
made-up words, broken as real pages are (unclosed elements, cut ends). The
number of pages and the seed are parameters; training is repeatable.

Scripts, styles, templates, titles, text areas, frames, comments and attributes
never become blocks; all other text does. A formula is part of the text around
it; drawings and what stands in for objects, media and scripts are blocks of
their own; a listing (``xmp``) is kept to the letter. Only a script or style
without an end tag reaches to the end of the page; other raw elements without
one lose their tag alone.
Character references are decoded once, white space inside a block becomes one
space, and main blocks are joined in page order by one space.

Reading a page takes time in proportion to its length, however its elements are
nested, left open or closed.

Defined results: null and empty pages, and pages without a main block, have
empty text; a page of bare text is one block; a tag or comment that the end of
the page cuts off is dropped; repeated rows get equal texts; an empty table
gives an empty result; pages of any length are read whole.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PATH_SLOTS, PATH_DIM = 1024, 16
WORD_SLOTS, WORD_DIM = 1024, 6
MEASURES = 6
HIDDEN = 12
#: Rule-written pages that the network is trained on, and how often.
PAGES = 2000
EPOCHS = 6
BATCH = 64
RATE = 0.02
#: Padded blocks that the network reads at a time.
CELLS = 200_000
#: Open elements that a path's vector counts: all, or this many where more are open, of which so many are the outermost.
DEPTH, OUTER = 32, 8

# Fixed values of HTML: elements without content, raw text, inline text, and
# what the start of an element closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title template iframe textarea".split())
TO_END = {"script", "style"}
#: Elements as if not there, besides their classes and ids; text within all but math is a block of its own.
CLEAR = set("audio canvas math noembed noframes noscript object svg video".split())
FOREIGN = {"math", "svg"}
#: Elements that only formulas and drawings have; of those in SPACED the text stands apart.
DRAWN = set(
    "annotation annotation-xml maction maligngroup malignmark menclose merror mfenced mfrac mglyph mi mlabeledtr mlongdiv mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstack mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics "
    "animate animatemotion animatetransform circle clippath defs desc ellipse filter foreignobject g image line lineargradient marker mask metadata mpath path pattern polygon polyline radialgradient rect set stop switch symbol text textpath tspan use view".split()
)
SPACED = set("annotation annotation-xml desc foreignobject metadata mtd mtr text".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | CLEAR
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(r"<!--(?P<comment>)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|<[!?/][^>]*+>")
_NAMED = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_END = {name: re.compile(rf"</{name}\s*+[^>]*+>", re.I) for name in (*RAW, "xmp")}
_PART = re.compile(r"[a-zA-Z0-9]+")


@dataclass
class Block:
    text: str
    path: list[int]
    leaf: str
    linked: int


def _slot(token: str) -> int:
    return crc32(token.encode()) % PATH_SLOTS


def _tokens(name: str, attrs: str) -> tuple[int, ...]:
    return _kept_tokens(name, attrs) if len(attrs) <= 200 else _new_tokens(name, attrs)


def _new_tokens(name: str, attrs: str) -> tuple[int, ...]:
    """Slots of an element's name and of the parts of its classes, ids and roles, each part once."""
    marks = dict.fromkeys(_slot(f".{p.lower()}") for _, a, b, c in _NAMED.findall(attrs) for p in _PART.findall(a or b or c))
    return (_slot(name), *marks)


_kept_tokens = functools.lru_cache(100_000)(_new_tokens)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    parts: list[str] = []
    path: list[int] = []
    leaf, linked, links, at = "", 0, 0, 0
    foreign, apart, began = 0, 0, 0
    endless: set[str] = set()
    #: Places in the stack of the open elements of each name, and of those that aren't inline.
    places: dict[str, list[int]] = {}
    solid: list[int] = []
    #: No tag ends beyond this; a search further on would only find that out again and again.
    limit = page.rfind(">") + 1

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, path, leaf, linked))
        parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal path, leaf, linked, began
        if text.isspace():
            if parts:
                parts.append(text)
            return
        if parts and apart != began:
            flush()
        if not parts:
            near = stack if len(stack) <= DEPTH else [*stack[:OUTER], *stack[OUTER - DEPTH :]]
            path = [t for _, tokens in near for t in tokens]
            leaf = stack[solid[-1]][0] if solid else ""
            began = apart
        parts.append(text)
        if links:
            linked += len(text)

    def push(name: str, tokens: tuple[int, ...]) -> None:
        nonlocal links, foreign, apart
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            solid.append(len(stack))
        stack.append((name, tokens))
        links += name == "a"
        foreign += name in FOREIGN
        apart += name in CLEAR and name != "math"

    def pop(to: int) -> None:
        nonlocal links, foreign, apart
        while len(stack) > to:
            name, _ = stack.pop()
            places[name].pop()
            if name not in INLINE:
                solid.pop()
            links -= name == "a"
            foreign -= name in FOREIGN
            apart -= name in CLEAR and name != "math"

    def top(names: Iterable[str]) -> int:
        """Place of the innermost open element of these names, or -1."""
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def skip(name: str) -> re.Match | None:
        """The next end tag of a raw element; one that is missing is sought once."""
        end = None if name in endless else _END[name].search(page, at, limit)
        if not end:
            endless.add(name)
        return end

    while m := _TAG.search(page, at, limit):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if m["comment"] is not None:
            at = page.find("-->", at)
            if at < 0:
                at = len(page)
                break
            at += 3
            continue
        raw = m["name"] or m["name2"]
        if not raw:
            continue
        name, attrs = raw.lower(), m["attrs"] or m["attrs2"] or ""
        if foreign and name in SPACED or name in CLEAR and name != "math":
            add(" ")
        if foreign and name in DRAWN:
            continue
        if m["end"] or m["end2"]:
            # an inline element is closed up to the next block only
            if name not in INLINE:
                flush()
            if (i := top((name,))) > (solid[-1] if solid and name in INLINE else -1):
                pop(i)
            continue
        if (foreign and name in RAW or name in FOREIGN) and attrs.endswith("/"):
            continue
        if name in CLEAR:
            push(name, _tokens(name, attrs)[1:])
            continue
        if name in INLINE and name not in VOID:
            push(name, _tokens(name, attrs))
            continue
        if name in RAW:
            if end := skip(name):
                at = end.end()
            elif name in TO_END:
                at = len(page)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                flush()
            continue
        flush()
        if solid and stack[solid[-1]][0] == "p":  # a block ends an open paragraph
            pop(solid[-1])
        if name in CLOSES:
            shut, within = CLOSES[name]
            if (i := top(shut)) > top(within):
                pop(i)
        if not attrs.endswith("/"):
            push(name, _tokens(name, attrs))
            if name == "xmp" and (end := skip(name)):
                if end.start() > at:
                    add(entities.escape(page[at : end.start()]))
                at = end.start()
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z/!?]", rest)
    add(rest[: cut.start()] if cut else rest) if rest else None
    flush()
    return out


def measures(b: Block, i: int, n: int) -> list[float]:
    size = len(b.text)
    stops = sum(map(b.text.count, ".,;:!?"))
    return [np.log1p(size) / 5, b.linked / size if b.linked < size else 1.0, min(1.0, 10 * stops / size), float(b.leaf == "p"), float(b.leaf[:1] == "h" and b.leaf[1:].isdigit()), i / n]


class Inputs:
    """Arrays of a list of pages' blocks."""

    def __init__(self, pages: list[list[Block]]):
        flat = [b for p in pages for b in p]
        self.sizes = np.array([len(p) for p in pages], np.int64)
        paths = [b.path or [0] for b in flat]
        self.path = np.array([t for p in paths for t in p], np.int64)
        self.path_n = np.array([len(p) for p in paths], np.int64)
        words = [[crc32(w) % WORD_SLOTS for w in b.text.lower().encode("utf-8", "replace").split()] or [0] for b in flat]
        self.word = np.array([w for x in words for w in x], np.int64)
        self.word_n = np.array([len(x) for x in words], np.int64)
        self.measures = np.array([measures(b, i, len(p)) for p in pages for i, b in enumerate(p)], np.float32).reshape(-1, MEASURES)


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(n) - n, axis=0) if len(n) else np.zeros((0, values.shape[1]), np.float32)


class Net:
    """Parameters by name; float32."""

    def __init__(self, rng: np.random.Generator):
        d = PATH_DIM + WORD_DIM + MEASURES
        new = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        self.p = {"path": new(PATH_SLOTS, PATH_DIM, s=0.3), "word": new(WORD_SLOTS, WORD_DIM, s=0.1), "out": new(2 * HIDDEN, s=0.3), "bias": np.zeros(1, np.float32)}
        for way in ("ahead", "back"):
            self.p |= {f"{way}_in": new(d, 4 * HIDDEN, s=0.2), f"{way}_re": new(HIDDEN, 4 * HIDDEN, s=0.2), f"{way}_b": np.concatenate([np.ones(HIDDEN), np.zeros(3 * HIDDEN)]).astype(np.float32)}

    def embed(self, x: Inputs) -> np.ndarray:
        return np.concatenate([_sums(self.p["path"][x.path], x.path_n), _sums(self.p["word"][x.word], x.word_n) / x.word_n[:, None].astype(np.float32), x.measures], 1)

    def lstm(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        k = HIDDEN
        u = x @ self.p[f"{way}_in"] + self.p[f"{way}_b"]
        h, c, out = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32), np.empty((*x.shape[:2], k), np.float32)
        for t in range(len(x)):
            g = u[t] + h @ self.p[f"{way}_re"]
            s = 1 / (1 + np.exp(-g[:, : 3 * k]))
            f, i, o, n = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :], np.tanh(g[:, 3 * k :])
            c1 = f * c + i * n
            tc = np.tanh(c1)
            if keep is not None:
                keep.append((h, c, f, i, o, n, tc))
            m = mask[t][:, None]
            h, c = o * tc * m, c1 * m
            out[t] = h
        return out

    def lstm_back(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list, d_out: np.ndarray) -> tuple[np.ndarray, dict]:
        k = HIDDEN
        dg_all = np.empty((*x.shape[:2], 4 * k), np.float32)
        d_re = np.zeros_like(self.p[f"{way}_re"])
        dh, dc = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
        for t in range(len(x) - 1, -1, -1):
            h, c, f, i, o, n, tc = keep[t]
            m = mask[t][:, None]
            dh, dc = (dh + d_out[t]) * m, dc * m
            dc = dc + dh * o * (1 - tc * tc)
            dg = np.concatenate([dc * c * f * (1 - f), dc * n * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - n * n)], 1)
            dg_all[t] = dg
            d_re += h.T @ dg
            dh, dc = dg @ self.p[f"{way}_re"].T, dc * f
        flat = dg_all.reshape(-1, 4 * k)
        return dg_all @ self.p[f"{way}_in"].T, {f"{way}_in": x.reshape(-1, x.shape[2]).T @ flat, f"{way}_re": d_re, f"{way}_b": flat.sum(0)}

    def odds(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray]:
        a = self.lstm("ahead", x, mask, keep and keep[0])
        b = self.lstm("back", x[::-1], mask[::-1], keep and keep[1])[::-1]
        both = np.concatenate([a, b], 2)
        return 1 / (1 + np.exp(-(both @ self.p["out"] + self.p["bias"]))), both

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of being main of each block of each page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            # pages of like length together, so that little is padding
            n, last = 1, len(pages[order[-1]])
            while n < len(order) and (n + 1) * last <= CELLS and n < 1024:
                n += 1
            group, order = order[-n:], order[:-n]
            x = Inputs([pages[i] for i in group])
            v, mask, at = _padded(self.embed(x), x.sizes)
            p, _ = self.odds(v, mask)
            for j, i in enumerate(group):
                out[i] = p[: len(pages[i]), j]
        return out


def _padded(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """(time, pages, values), mask (time, pages), and where each row went."""
    t = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    page = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros((int(sizes.max()), len(sizes), values.shape[1]), np.float32)
    out[t, page] = values
    return out, (np.arange(len(out))[:, None] < sizes[None, :]).astype(np.float32), (t, page)


# What elements of pages are commonly named, and words of their texts.
MAIN = "article|main|div class=content|div class='post-content entry'|div id=content|section class=article-body|div class=story|div itemprop=articleBody|td class=content|div role=main|div class='page body text'"
NOT_MAIN = {
    "menu": "nav|div class=menu|ul class='nav navbar'|div id=navigation|div class=breadcrumbs|div role=navigation|div class=topbar|nav class=toc|div class='pagination pager'|ul class=menu",
    "header": "header|div id=header|div class='site-header masthead'|div class=logo|div class=branding|div role=banner",
    "footer": "footer|div id=footer|div class='site-footer'|div class=copyright|div role=contentinfo|div class=legal|div class=colophon",
    "side": "aside|div class=sidebar|div id=sidebar|div class=widget|div class=related|div class='related-posts recommended'|div class=tags|div class=share|div class='social sharing'|div role=complementary|aside class=teaser|div class=author-bio|div class=trending",
    "notice": "div class='cookie-notice'|div class=notice|div id=cookie-banner|div class='alert warning'|div class=consent|div class=gdpr|div class='popup modal'|div class=paywall|div class=disclaimer|div role=alert|div class=notification",
    "advert": "div class=ad|div class=ads|div class=advert|div class=advertisement|div class='ad-slot banner'|div class=sponsored|div id=ad-1|aside class=ad|section class=promo|div class=promoted|ins class=adsbygoogle",
    "form": "form|form class=search|div class=newsletter|div class='signup subscribe'|form class=login|div class=contact-form|form id=comment-form|fieldset|div class=poll",
    "comments": "section class=comments|div id=comments|div class=comment|div class='comment-list'|ol class=commentlist|div class=replies|section id=disqus|div class=reader-comments|div class=discussion|div class=responses",
}
HINTS = {
    "menu": "home about contact news products next previous top archive login",
    "header": "welcome logo daily online search",
    "footer": "© copyright all rights reserved privacy terms imprint &middot; example.com",
    "side": "related share follow popular tags recent more read",
    "notice": "we use cookies accept this site policy please enable agree",
    "advert": "ad sponsored buy now sale offer free click advertisement",
    "form": "name email submit subscribe password search your send",
    "comments": "reply said comment posted by ago likes wrote comments",
}


def example(rng: random.Random) -> tuple[str, list[bool]]:
    """A page written by rule and whether each of its blocks is main."""
    syllables = ["".join(rng.choice("bcdfghklmnprstvwz") + rng.choice("aeiouäéíóü") for _ in range(rng.randint(1, 2))) for _ in range(40)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    plain = rng.random() < 0.3
    html: list[str] = []
    labels: list[bool] = []

    def text(n: int, hints: str = "", stops: bool = True) -> str:
        w = [rng.choice(hints.split()) if hints and not plain and rng.random() < 0.4 else word() for _ in range(n)]
        junk = rng.choice(["&amp;&amp;", "%%%", "***", "!!"]) if rng.random() < 0.05 else ""
        out = [x + junk + (rng.choice([".", ",", ".", "!", "?"]) if stops and rng.random() < 0.15 else "") for x in w]
        if rng.random() < 0.2 and n > 3:
            i = rng.randrange(n)
            t = rng.choice(["b", "i", "em", "a href=x", "span"])
            out[i] = f"<{t}>{out[i]}</{t.split()[0]}>"
        return " ".join(out) + ("." if stops and rng.random() < 0.8 else "")

    def leaf(tag: str, body: str, main: bool) -> None:
        html.append(f"<{tag}>{body}" + (f"</{tag.split()[0]}>" if tag[0] == "h" or rng.random() < 0.93 else ""))
        labels.append(main)

    def wrap(tag: str, inner) -> None:
        html.append(f"<{tag}>")
        inner()
        html.append(f"</{tag.split()[0]}>")

    def boiler(kind: str) -> None:
        hints = HINTS[kind]

        def inner() -> None:
            style = rng.random()
            if kind == "menu" or (kind in ("side", "footer", "header") and style < 0.4):
                html.append("<ul>")
                for _ in range(rng.randint(2, 8)):
                    leaf("li", f"<a href=/{word()}>{text(rng.randint(1, 3), hints, False)}</a>", False)
                html.append("</ul>")
            elif kind == "form":
                for _ in range(rng.randint(1, 3)):
                    leaf(rng.choice(["label", "p", "div", "button"]) if rng.random() < 0.8 else "p", text(rng.randint(1, 9), hints), False)
                    html.append("<br><input type=text>")
            elif kind == "comments":
                if rng.random() < 0.6:
                    leaf(rng.choice(["h2", "h3", "h4"]), text(2, hints, False), False)
                for _ in range(rng.randint(1, 5)):
                    n = rng.choice([8, 20, 45, 80])
                    if rng.random() < 0.5:
                        html.append(f"<{(t := rng.choice(['div class=comment', 'li', 'article class=comment']))}>")
                        leaf("p", text(3, hints, False), False)
                        leaf("p", text(n, hints if rng.random() < 0.3 else ""), False)
                        html.append(f"</{t.split()[0]}>")
                    else:
                        leaf("p", text(n, hints if rng.random() < 0.3 else ""), False)
            else:
                if rng.random() < 0.3 and kind in ("side", "header", "notice", "advert"):
                    leaf(rng.choice(["h1", "h2", "h3"]), text(rng.randint(1, 5), hints, False), False)
                for _ in range(rng.randint(1, 3)):
                    body = text(rng.choice([2, 6, 12, 30]), hints)
                    if rng.random() < 0.5:
                        leaf(rng.choice(["p", "div", "span class=x"][:2]), body, False)
                    else:
                        html.append(body + "<br>")
                        labels.append(False)

        wrap(rng.choice(NOT_MAIN[kind].split("|")), inner)

    def article() -> None:
        def inner() -> None:
            if rng.random() < 0.7:
                head = lambda: leaf(rng.choice(["h1", "h1", "h2"]), text(rng.randint(1, 10), stops=False), True)
                wrap("header", head) if rng.random() < 0.15 else head()
            for _ in range(rng.choice([1, 2, 4, 8, 14])):
                kind = rng.random()
                if kind < 0.62:
                    leaf("p", text(rng.choice([1, 4, 15, 40, 90])), True)
                elif kind < 0.72:
                    html.append("<p><b>" + text(rng.choice([3, 12, 30])) + "<br>")
                    labels.append(True)
                elif kind < 0.78:
                    leaf(rng.choice(["h2", "h3"]), text(rng.randint(1, 6), stops=False), True)
                elif kind < 0.83:
                    t = rng.choice(["ul", "ol"])
                    html.append(f"<{t}>")
                    for _ in range(rng.randint(2, 5)):
                        leaf("li", text(rng.randint(1, 12)), True)
                    html.append(f"</{t}>")
                elif kind < 0.87:
                    wrap("blockquote", lambda: leaf("p", text(20), True))
                elif kind < 0.90:
                    leaf("pre", text(8), True)
                elif kind < 0.93:
                    wrap("table", lambda: wrap("tr", lambda: [leaf("td", text(2), True) for _ in range(3)]))
                elif kind < 0.95:
                    wrap("figure", lambda: leaf("figcaption", text(6), True))
                else:
                    boiler(rng.choice(["advert", "side", "notice", "form", "menu"]))
            if rng.random() < 0.15:
                boiler("comments")

        tag = rng.choice(MAIN.split("|")) if rng.random() < 0.55 else "article" if rng.random() < 0.8 else "div"
        wrap(tag, inner)

    before = [k for k in ("menu", "header", "notice", "advert", "form", "side") if rng.random() < (0.6 if k == "menu" else 0.3)]
    after = [k for k in ("comments", "side", "advert", "form", "notice", "menu", "footer") if rng.random() < (0.7 if k == "footer" else 0.25)]
    rng.shuffle(before)
    shell = rng.random() < 0.3
    html.append("<html><head><title>x</title></head><body>" + ("<div class='page wrapper'>" if shell else ""))
    for k in before:
        boiler(k)
    article()
    if rng.random() < 0.1:
        boiler("advert")
        article()
    for k in after:
        boiler(k)
    html.append(("</div>" if shell else "") + ("</body></html>" if rng.random() < 0.9 else ""))
    return "".join(html), labels


@functools.lru_cache(2)
def train(pages: int = PAGES, seed: int = 11) -> Net:
    rng = random.Random(seed)
    data = []
    while len(data) < pages:
        page, y = example(rng)
        b = blocks(page)
        if len(b) == len(y) and b:
            data.append((b, y))
    net = Net(np.random.default_rng(seed))
    m, v = {k: np.zeros_like(x) for k, x in net.p.items()}, {k: np.zeros_like(x) for k, x in net.p.items()}
    step, steps = 0, EPOCHS * (-(-pages // BATCH))
    for _ in range(EPOCHS):
        rng.shuffle(data)
        by_length = sorted(range(len(data)), key=lambda i: len(data[i][0]) + rng.random() * 6)
        batches = [by_length[i : i + BATCH] for i in range(0, len(data), BATCH)]
        rng.shuffle(batches)
        for batch in batches:
            x = Inputs([data[i][0] for i in batch])
            # a fifth of path and word vectors are left out, so that neither is relied on alone
            drop = np.random.default_rng(step)
            keep_p, keep_w = (drop.random(len(x.path)) > 0.2).astype(np.float32), (drop.random(len(x.word)) > 0.2).astype(np.float32)
            e = np.concatenate([_sums(net.p["path"][x.path] * keep_p[:, None], x.path_n), _sums(net.p["word"][x.word] * keep_w[:, None], x.word_n) / x.word_n[:, None].astype(np.float32), x.measures], 1)
            xs, mask, (t, page) = _padded(e, x.sizes)
            y = np.zeros(mask.shape, np.float32)
            y[t, page] = np.concatenate([np.array(data[i][1], np.float32) for i in batch])
            keep: tuple[list, list] = ([], [])
            p, both = net.odds(xs, mask, keep)
            d = ((p - y) * mask / mask.sum()).astype(np.float32)
            d_both = d[:, :, None] * net.p["out"]
            da, ga = net.lstm_back("ahead", xs, mask, keep[0], d_both[:, :, :HIDDEN])
            db, gb = net.lstm_back("back", xs[::-1], mask[::-1], keep[1], d_both[::-1, :, HIDDEN:])
            de = (da + db[::-1])[t, page]
            g = {**ga, **gb, "out": (both * d[:, :, None]).sum((0, 1)), "bias": np.array([d.sum()], np.float32)}
            g["path"], g["word"] = np.zeros_like(net.p["path"]), np.zeros_like(net.p["word"])
            np.add.at(g["path"], x.path, np.repeat(de[:, :PATH_DIM], x.path_n, 0) * keep_p[:, None])
            dw = de[:, PATH_DIM : PATH_DIM + WORD_DIM] / x.word_n[:, None].astype(np.float32)
            np.add.at(g["word"], x.word, np.repeat(dw, x.word_n, 0) * keep_w[:, None])
            step += 1
            rate = RATE * (1 - 0.9 * step / max(step, steps))
            for k, value in net.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                value -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def main_texts(net: Net, pages: list[str]) -> list[str]:
    cut = [blocks(p) if p else [] for p in pages]
    return [" ".join(b.text for b, x in zip(bs, p, strict=True) if x > 0.5) for bs, p in zip(cut, net.label(cut), strict=True)]


def extract(pages: DataFrame, net: Net | None = None, column: str = "html") -> DataFrame:
    """``pages`` with main_text (in place of ``column``)."""
    net = net or train()
    names = [c for c in pages.columns if c not in (column, "main_text")]
    schema = T.StructType([*[pages.schema[c] for c in names], T.StructField("main_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = main_texts(net, [x or "" for x in b.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(texts, pa.string())], names=[*names, "main_text"])

    return pages.select(*names, column).mapInArrow(run, schema)


def op5_extract(spark, sf_dir: str) -> DataFrame:
    x = extract(common.read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return x.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
