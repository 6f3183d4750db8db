"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its text blocks with features of their ancestors (tags, words of
class, id and role) and of their text. The field is trained on labelled pages made by a seeded
generator of common page layouts, and blocks are decoded by Viterbi.
"""

from __future__ import annotations

import html
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from collatrix.llm.common import map_arrow, ship, table

# Elements without text of the page, elements without content, elements inside a line,
# and, of block elements, what an opening tag ends.
DROPPED = frozenset("title script style noscript template svg iframe object canvas math audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
ENDS = {
    "li": ("li", ("ul", "ol", "menu")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
TAGS = "article main section nav header footer aside form table ul ol li dl p h1 h2 h3 h4 h5 h6 div blockquote pre figure figcaption button select textarea fieldset dialog details address td body".split()
#: Word stems of class, id and role, by what they tell.
ROLES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs toolbar skip",
    "head": "header masthead banner topbar hero logo brand",
    "foot": "footer foot contentinfo copyright legal colophon credits",
    "side": "sidebar side aside complementary widget rail secondary",
    "ad": "ad ads advert advertisement adsense adslot sponsor sponsored promo promotion promoted affiliate",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay dialog toast message warning paywall announcement",
    "form": "form search login signup subscribe newsletter subscription register contact",
    "talk": "comment comments commentlist reply replies respond discussion disqus feedback reviews responses",
    "more": "related recommended recommendations share sharing social similar trending popular latest tags taglist byline meta author",
    "body": "content article post entry story text body main prose page articlebody maincontent",
}
_ROLE_OF = {w: r for r, words in ROLES.items() for w in words.split()}
#: Words of the text itself that boilerplate is made of.
PHRASES = re.compile(
    r"©|\(c\) |copyright|all rights reserved|cookie|privacy|terms of (?:use|service)|subscribe|newsletter|sign (?:in|up)|log ?in|"
    r"advertis|sponsored|read more|share (?:this|on)|related|comment|reply|click here|menu|skip to|follow us|consent",
    re.I,
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_STEM = re.compile(r"[a-z]+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What ends a tag, or begins a quoted value in it.
_IN_TAG = re.compile(r""">|=\s*["']""")
#: Elements whose content is no markup: left open, they reach to the end of the page.
RAW = frozenset("script style title iframe noscript".split())
_SHUT = {t: re.compile(f"</{t}", re.I | re.A) for t in DROPPED}
_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_ROLE_BIT = {r: 1 << i for i, r in enumerate(ROLES)}


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Tags in page order, as (start, end, lower-case name, whether it closes, attributes); comments and
    declarations have no name, and nothing between tags is looked at. What is dropped with its
    content comes as one tag. Each character is looked at a bounded number of times: what was once
    found missing in the rest of the page isn't searched again. A tag that never ends, or a comment,
    reaches to the end of the page; a quote that never closes is an ordinary character."""
    at, n = 0, len(page)
    missing: set[str] = set()

    def ahead(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while (start := ahead("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        if after == "!" or after == "?":
            end = ahead("-->", start + 4) + 3 if page.startswith("<!--", start) else ahead(">", start) + 1
            end = end if end > start else n
            yield start, end, "", False, ""
            at = end
            continue
        closes = after == "/"
        name = _NAME.match(page, start + 1 + closes)
        if name is None:
            at = start + 1
            continue
        place, end = name.end(), n
        while m := _IN_TAG.search(page, place):
            if m[0] == ">":
                end = m.end()
                break
            shut = ahead(m[0][-1], m.end())
            place = shut + 1 if shut >= 0 else m.end()
        word, attributes = name[0].lower(), page[name.end() : max(name.end(), end - 1)]
        if word in DROPPED and not closes and not attributes.endswith("/"):
            shut = None if f"</{word}" in missing else _SHUT[word].search(page, end)
            if shut is None:
                missing.add(f"</{word}")
                end = n if word in RAW else end
            else:
                close = ahead(">", shut.end())
                end = close + 1 if close >= 0 else n
        yield start, end, word, closes, attributes
        at = end


@dataclass
class Block:
    """One leaf block: its text, which tags and roles stand above it as bit sets (``near``: roles of the
    two nearest elements, ``far``: those that only others have), the innermost tag, whether the
    nearest element with a role is main content, and characters in links."""

    text: str
    tags: int
    leaf: str
    near: int
    far: int
    in_body: bool
    linked: int


def _roles(attributes: str) -> int:
    if "=" not in attributes:
        return 0
    out = 0
    for m in _ATTRIBUTE.finditer(attributes):
        for s in _STEM.findall((m[1] or m[2] or m[3] or "").lower()):
            if s in _ROLE_OF:
                out |= _ROLE_BIT[_ROLE_OF[s]]
    return out


class _Stack:
    """Open elements. Each holds the sets of tags and roles from the outside to itself, and places of open
    elements are kept by name, so no question walks over the stack."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, int, int, int]] = []  # name, tags, roles, all roles, the nearest that aren't empty
        self.places: dict[str, list[int]] = {}

    def push(self, name: str, roles: int) -> None:
        _, tags_, _, all_, nearest = self.rows[-1] if self.rows else ("", 0, 0, 0, 0)
        self.places.setdefault(name, []).append(len(self.rows))
        self.rows.append((name, tags_ | _BIT.get(name, 0), roles, all_ | roles, roles or nearest))

    def last(self, names: tuple[str, ...]) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def cut(self, at: int) -> None:
        while len(self.rows) > at:
            self.places[self.rows.pop()[0]].pop()


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order. Inline elements and line breaks stay inside a block; scripts, styles,
    comments and other markup go; character references are decoded and white space is one space.
    Time and memory are linear in the page, however broken its markup is."""
    out: list[Block] = []
    stack = _Stack()
    pieces: list[str] = []
    linked = in_link = 0
    hints: list[int] = []  # roles of the last inline elements open in this block, at most two, and of all of them
    hinted = 0

    def close() -> None:
        nonlocal linked, hinted
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                name, tags_, _, all_, nearest = stack.rows[-1] if stack.rows else ("", 0, 0, 0, 0)
                near = 0
                for r in [*[r[2] for r in stack.rows[-2:]], *hints][-2:]:
                    near |= r
                nearest = next((h for h in reversed(hints) if h), nearest)
                out.append(Block(text, tags_, name, near, (all_ | hinted) & ~near, bool(nearest & _ROLE_BIT["body"]), min(linked, len(text))))
            pieces.clear()
        hints.clear()
        linked = hinted = 0

    at = 0
    for start, end, name, closes, attributes in itertools.chain(tags(page), [(len(page), len(page), "", False, "")]):
        if start > at:
            pieces.append(page[at:start])
            if in_link:
                linked += start - at
        at = end
        if not name:
            continue
        if closes:
            if name == "a":
                in_link = 0
            elif name == "p" and not stack.places.get("p"):
                close()
            elif name not in INLINE and name not in VOID and stack.places.get(name):
                close()
                stack.cut(stack.places[name][-1])
            continue
        if name in DROPPED:
            close() if name not in ("svg", "math") else None
            continue
        if name in VOID:
            if name == "br":
                pieces.append(" ")
            elif name == "hr":
                close()
            continue
        if name in INLINE:
            if name == "a":
                in_link = 1
            if r := _roles(attributes):
                hints[:] = [*hints[-1:], r]
                hinted |= r
            continue
        close()
        in_link = 0
        ends, within = ENDS.get(name, ("", ()))
        if ends and (place := stack.last(tuple(ends.split()))) > stack.last(within):
            stack.cut(place)
        if stack.rows and stack.rows[-1][0] == "p":  # a block element ends a paragraph
            stack.cut(len(stack.rows) - 1)
        stack.push(name, _roles(attributes))
    close()
    return out


_NAMES: dict[str, int] = {}
for _t in TAGS:
    _NAMES[f"in {_t}"] = len(_NAMES)
    _NAMES[f"leaf {_t}"] = len(_NAMES)
for _r in ROLES:
    for _near in ("near", "far"):
        _NAMES[f"{_near} {_r}"] = len(_NAMES)
for _f in (
    "bias", "words 1", "words 4", "words 10", "words 25", "words more", "links none", "links some", "links most", "sentence", "phrase", "phrase in short",
    "first", "last", "no tag", "article or body near", "outside article", "list of links",
):
    _NAMES[_f] = len(_NAMES)


@lru_cache(4096)
def _above(tags_: int, leaf: str, near: int, far: int, in_body: bool) -> tuple[int, ...]:
    """Numbers of the features of what stands above a block, which few kinds of places share."""
    f = ["bias", *[f"in {t}" for t, bit in _BIT.items() if tags_ & bit], f"leaf {leaf}" if leaf else "no tag"]
    f += [f"near {r}" for r, bit in _ROLE_BIT.items() if near & bit] + [f"far {r}" for r, bit in _ROLE_BIT.items() if far & bit]
    f += ["article or body near"] * in_body
    return tuple(_NAMES[x] for x in f if x in _NAMES)


def features(page: list[Block]) -> list[list[int]]:
    """Numbers of the features that each block has."""
    article = _BIT["article"] | _BIT["main"]
    has_article = any(b.tags & article for b in page)
    out = []
    for i, b in enumerate(page):
        f = []
        words = b.text.count(" ") + 1
        f.append("words 1" if words == 1 else "words 4" if words <= 4 else "words 10" if words <= 10 else "words 25" if words <= 25 else "words more")
        share = b.linked / len(b.text)
        f.append("links none" if not b.linked else "links some" if share < 0.5 else "links most")
        if share >= 0.5 and b.tags & _BIT["li"]:
            f.append("list of links")
        if b.text[-1] in ".!?:;\"')”»":
            f.append("sentence")
        if PHRASES.search(b.text):
            f.append("phrase in short" if words <= 25 else "phrase")
        if i == 0:
            f.append("first")
        if i == len(page) - 1:
            f.append("last")
        if has_article and not b.tags & article:
            f.append("outside article")
        out.append([*_above(b.tags, b.leaf, b.near, b.far, b.in_body), *[_NAMES[x] for x in f]])
    return out


@dataclass
class Field:
    """Weights of features for label 1 (main text) against label 0, and of neighbouring labels."""

    weights: list[float]
    moves: list[list[float]]

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels (Viterbi); ties go to label 0."""
        (m00, m01), (m10, m11) = self.moves
        w = self.weights
        a, b, back = 0.0, 0.0, []
        for i, row in enumerate(rows):
            e = sum([w[f] for f in row])
            if i:
                to0, to1 = (a + m00, 0) if a + m00 >= b + m10 else (b + m10, 1), (a + m01, 0) if a + m01 >= b + m11 else (b + m11, 1)
                back.append((to0[1], to1[1]))
                a, b = to0[0], to1[0] + e
            else:
                a, b = 0.0, e
        labels = [1 if b > a else 0] if rows else []
        for to in reversed(back):
            labels.append(to[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 250, penalty: float = 1e-3) -> Field:
    """Penalised conditional likelihood, maximised by Adam over forward-backward gradients of all pages
    at once (padded to the longest)."""
    n, d, longest = len(pages), len(_NAMES), max(len(x) for x, _ in pages)
    x = np.zeros((n, longest, d))
    y = np.zeros((n, longest), int)
    live = np.zeros((n, longest), bool)
    for i, (rows, labels) in enumerate(pages):
        for t, row in enumerate(rows):
            x[i, t, row] = 1
        y[i, : len(labels)] = labels
        live[i, : len(labels)] = True
    pair = live[:, 1:]
    true_moves = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)], float)
    true_weights = np.einsum("ntd,nt->d", x, (y * live).astype(float))
    theta, first, second = np.zeros(d + 4), np.zeros(d + 4), np.zeros(d + 4)
    total = live.sum()
    flat = x.reshape(-1, d)
    for step in range(1, rounds + 1):
        w, m = theta[:d], theta[d:].reshape(2, 2)
        e = np.zeros((n, longest, 2))
        e[:, :, 1] = (flat @ w).reshape(n, longest)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(forward[:, t - 1, None, 0] + m[0], forward[:, t - 1, None, 1] + m[1]) + e[:, t]
            forward[:, t] = np.where(live[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = e[:, t + 1] + backward[:, t + 1]
            new = np.logaddexp(m[:, 0] + after[:, None, 0], m[:, 1] + after[:, None, 1])
            backward[:, t] = np.where(live[:, t + 1, None], new, backward[:, t + 1] * 0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p1 = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None]) * live
        both = forward[:, :-1, :, None] + m + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]
        expected = (np.exp(both) * pair[:, :, None, None]).sum((0, 1))
        grad = np.concatenate([true_weights - flat.T @ p1.ravel(), (true_moves - expected).ravel()]) / total - penalty * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:d].tolist(), theta[d:].reshape(2, 2).tolist())


class _Maker:
    """Labelled pages: every piece of text carries a mark of its label, so that parsing a made page
    gives its blocks with their labels."""

    SYLLABLES = "an be co da el fo ga hu in ka lo ma ne or pa qui ra se ti um ver wa xe yo zu".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        out = ["".join(self.r.choice(self.SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(self.r.randint(low, high))]
        for i in range(len(out)):
            if self.r.random() < 0.08 and i + 1 < len(out):
                out[i] += self.r.choice([".", ",", ";"])
        return " ".join(out).capitalize()

    def text(self, label: int, low: int, high: int, end: str | None = None) -> str:
        end = self.r.choice([".", ".", ".", "", "!", "?"]) if end is None else end
        return f"\x01{label}\x02{self.words(low, high)}{end}"

    def pick(self, role: str) -> str:
        word = self.r.choice(ROLES[role].split())
        form = self.r.choice(["{}", "{}", "site-{}", "{}-box", "page-{}-wrap", "{}-1"]).format(word)
        return self.r.choice([f' class="{form}"', f' id="{form}"', f" class={form}", f' class="x {form} y"'])

    def maybe(self, role: str, p: float = 0.6) -> str:
        return self.pick(role) if self.r.random() < p else ""

    def links(self, label: int = 0) -> str:
        many = self.r.randint(2, 9)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/x">{self.text(label, 1, 3, "")}</a></li>' for _ in range(many)) + "</ul>"
        return "".join(f'<div><a href="/x">{self.text(label, 1, 3, "")}</a></div>' for _ in range(many))

    def prose(self) -> str:
        out = []
        for _ in range(self.r.randint(1, 12)):
            kind = self.r.random()
            if kind < 0.72:
                out.append(self.r.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>"]).format(self.text(1, 1, 70)))
            elif kind < 0.8:
                out.append(f"<h{self.r.randint(2, 4)}>{self.text(1, 1, 8, '')}</h{3}>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.text(1, 2, 20)}</li>" for _ in range(self.r.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{self.text(1, 5, 30)}</p></blockquote>")
            elif kind < 0.93:
                out.append(f"<p>{self.text(1, 6, 25)} <a href='/y'>{self.words(1, 3)}</a> {self.words(2, 9)}.</p>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{self.text(1, 1, 4, '')}</td><td>{self.text(1, 1, 4, '')}</td></tr>" for _ in range(2)) + "</table>")
            else:
                out.append(self.junk(inside=True))
        return "".join(out)

    def junk(self, inside: bool = False) -> str:
        kinds = ["ad", "notice", "more", "form", "ad"] + ([] if inside else ["side", "menu", "talk", "foot"])
        role = self.r.choice(kinds)
        if role == "form":
            return f"<form{self.maybe('form')}><label>{self.text(0, 1, 4, '')}</label><input name=q><button>{self.text(0, 1, 2, '')}</button></form>"
        if role == "talk":
            each = "".join(f"<{t}{self.pick('talk')}><p>{self.text(0, 3, 50)}</p></{t}>" for t in [self.r.choice(["div", "li", "article"])] for _ in range(self.r.randint(1, 5)))
            return f"<{(t := self.r.choice(['section', 'div', 'ol']))}{self.pick('talk')}><h3>{self.text(0, 1, 3, '')}</h3>{each}</{t}>"
        if role == "menu":
            return self.r.choice([f"<nav{self.maybe('menu')}>{self.links()}</nav>", f"<div{self.pick('menu')}>{self.links()}</div>"])
        if role == "side":
            inner = self.r.choice([self.links(), f"<h4>{self.text(0, 1, 3, '')}</h4><p>{self.text(0, 3, 30)}</p>"])
            return self.r.choice([f"<aside{self.maybe('side')}>{inner}</aside>", f"<div{self.pick('side')}>{inner}</div>"])
        if role == "foot":
            return f"<div{self.pick('foot')}>{self.text(0, 2, 14)}</div>"
        tag = self.r.choice(["div", "p", "section", "aside"])
        inner = self.links() if role == "more" and self.r.random() < 0.6 and tag != "p" else self.text(0, 2, 30) if tag == "p" or self.r.random() < 0.6 else f"<p>{self.text(0, 2, 30)}</p>"
        return f"<{tag}{self.pick(role)}>{inner}</{tag}>"

    def page(self) -> str:
        r = self.r
        top = []
        if r.random() < 0.6:
            top.append(f"<header{self.maybe('head', 0.3)}>{self.r.choice([self.text(0, 1, 6, ''), f'<h2>{self.text(0, 1, 6)}</h2>', f'<p>{self.text(0, 2, 16)}</p>'])}</header>")
        if r.random() < 0.8:
            top.append(r.choice([f"<nav{self.maybe('menu', 0.3)}>{self.links()}</nav>", f"<div{self.pick('menu')}>{self.links()}</div>"]))
        top += [self.junk() for _ in range(r.randint(0, 3))]
        heading = f"<h1>{self.text(1, 2, 14, r.choice(['', '.', '']))}</h1>" if r.random() < 0.85 else ""
        body = heading + self.prose()
        wrap = r.random()
        if wrap < 0.5:
            body = f"<article{self.maybe('body', 0.3)}>{body}</article>"
        elif wrap < 0.65:
            body = f"<main>{body}</main>"
        elif wrap < 0.95:
            body = f"<div{self.pick('body')}>{body}</div>"
        end = [self.junk() for _ in range(r.randint(0, 3))]
        if r.random() < 0.85:
            note = self.r.choice(["&copy; site.example &middot; ", "Copyright 2024 ", "", ""])
            label = self.text(0, 2, 18)
            label = label.replace("\x02", "\x02" + note, 1)
            end.append(r.choice([f"<footer{self.maybe('foot', 0.3)}>{label}</footer>", f"<footer><p>{label}</p>{self.links()}</footer>", f"<div{self.pick('foot')}>{label}</div>"]))
        middle = [body]
        if r.random() < 0.25:
            middle.insert(r.randint(0, 1), self.junk())
        inside = "".join([*top, *middle, *end])
        if r.random() < 0.2:
            inside = f'<div id="{r.choice(["wrapper", "app", "root", "page"])}">{inside}</div>'
        return f"<html><head><title>t</title></head><body>{inside}</body></html>"


_MARK = re.compile("\x01([01])\x02")


def labelled_pages(number: int, seed: int) -> list[tuple[list[Block], list[int]]]:
    """Made pages as blocks and their labels (1: main text)."""
    maker, out = _Maker(seed), []
    for _ in range(number):
        page, labels = [], []
        for b in blocks(maker.page()):
            marks = _MARK.findall(b.text)
            labels.append(int(marks[0]) if marks else 0)
            text = _MARK.sub("", b.text).strip()
            page.append(replace(b, text=text or "x", linked=min(b.linked, len(text))))
        if page:
            out.append((page, labels))
    return out


@cache
def trained(number: int = 600, seed: int = 5) -> Field:
    return train([(features(p), y) for p, y in labelled_pages(number, seed)])


def main_text(page: str, model: Field) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, model.decode(features(found)), strict=True) if label)


def extract(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` and ``text`` of each row: its main blocks, joined by newlines.

    Null or empty html gives the empty text, and so does a page without main blocks. Broken markup
    is read as far as it goes (unclosed elements end with their parent, stray ends are ignored; of
    what is dropped with its content, only scripts, styles, titles, frames and noscript reach to the
    end of the page if they aren't closed). Reading takes time linear in the page.
    The whole html is read and nothing is cut. Repeated rows give repeated results; an empty table
    gives no rows; columns not in ``keep`` are ignored.
    """
    ship(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, sent.value) if h else "" for h in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(pages.select(*keep, pages[column].alias("_html")), run, f"{schema}, text string")


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.selectExpr("page_id", "url", "text", "cast(char_length(text) as long) as n_chars")
