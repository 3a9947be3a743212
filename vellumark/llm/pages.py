"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree."""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellumark.llm import crf

#: No text of these is shown, or it belongs to a form.
_HIDDEN = {"script", "style", "template", "iframe", "title", "desc", "metadata", "select", "datalist", "textarea", "head"}
#: Elements that stay open where a block around them ends, each at most three times.
_FORMAT = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
_BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An open element of the key is ended by a start tag of the value.
_ENDS = {
    "p": _BLOCK - {"button"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
}
_WHITE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
#: Words of class, id and role names, by what they say about an element.
_HINTS = {
    "menu": "nav menu navbar breadcrumb breadcrumbs toc pagination pager tabs tab skip sitemap topbar links navigation",
    "head": "header masthead banner branding logo hero top",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar aside side widget related recommended rail trending popular teaser more complementary recommendations",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion dfp banner commercial",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay newsletter subscribe signup paywall disclaimer toast",
    "form": "form search login signin register input contact poll survey",
    "comment": "comment comments reply replies disqus respond discussion responses review reviews feedback",
    "share": "share social sharing follow twitter facebook author byline meta tags tag date",
    "main": "article content main post entry story body text prose page blog news markdown document articlebody",
}
_HINT_OF = {w: k for k, names in _HINTS.items() for w in names.split()}
_TAGS = "article main section aside nav header footer form ul ol table blockquote pre figure details dialog address dl h1 h2 h3 p li td div button label body a b".split()
_ROLES = {"navigation": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side", "search": "form", "main": "main", "dialog": "notice", "alert": "notice", "form": "form", "article": "main"}


_PLACE = {name: i for i, name in enumerate([*_TAGS, *(f"+{h}" for h in _HINTS)])}


class Open(NamedTuple):
    """An open element: its name, whether its text is hidden, its own marks (bits of _PLACE), and those of all elements down to it."""

    tag: str
    hidden: bool
    own: int
    marks: int


class Blocks(HTMLParser):
    """Cuts a page to leaf blocks: runs of text that no block element interrupts, with the marks of the elements around.

    Every open element carries the marks of those around it, so memory and time follow the page and not its depth.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[Open] = []
        self.open: Counter[str] = Counter()
        self.hidden = 0
        self.out: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.linked = self.pieces = 0

    def flush(self) -> None:
        text = _WHITE.sub(" ", "".join(self.text)).strip()
        if text:
            self.out.append((text, self.stack[-1].marks if self.stack else 0, self.linked, self.pieces))
        self.text, self.linked, self.pieces = [], 0, 0

    def push(self, tag: str, hidden: bool, own: int) -> None:
        self.stack.append(Open(tag, hidden, own, own | (self.stack[-1].marks if self.stack else 0)))
        self.open[tag] += 1
        self.hidden += hidden

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while self.stack and tag in _ENDS.get(self.stack[-1].tag, ()):
            self.close(len(self.stack) - 1)
        if tag in _BLOCK and any(self.open[t] for t in _ENDS):
            for i in range(len(self.stack) - 1, -1, -1):  # an open p, li, ... may lie below inline elements
                if tag in _ENDS.get(self.stack[i].tag, ()):
                    self.close(i, keep_inline=True)
                    break
                if self.stack[i].tag in _BLOCK:
                    break
        if tag in _BLOCK and not self.hidden:
            self.flush()
        if tag == "br":
            self.text.append(" ")
        if tag in _VOID:
            return
        own, off = 1 << _PLACE[tag] if tag in _PLACE else 0, tag in _HIDDEN
        for k, v in attrs:
            if v and k in ("class", "id", "role", "itemprop", "aria-label"):
                if k == "role" and v in _ROLES:
                    own |= 1 << _PLACE["+" + _ROLES[v]]
                for w in _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()):
                    if w in _HINT_OF:
                        own |= 1 << _PLACE["+" + _HINT_OF[w]]
            off |= k == "hidden" or (k == "style" and bool(v) and "display:none" in v.replace(" ", "").lower()) or (k == "aria-hidden" and v == "true")
        self.push(tag, off, own)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def close(self, at: int, keep_inline: bool = False) -> None:
        """End the element at this place of the stack, and those above it; formatting elements above it may stay open."""
        gone = self.stack[at:]
        if not self.hidden and any(t.tag in _BLOCK for t in gone):
            self.flush()
        del self.stack[at:]
        for t in gone:
            self.open[t.tag] -= 1
            self.hidden -= t.hidden
        if keep_inline:
            kept: Counter[str] = Counter()
            stay = []
            for t in reversed(gone[1:]):
                if t.tag in _FORMAT and not t.hidden and kept[t.tag] < 3:
                    kept[t.tag] += 1
                    stay.append(t)
            for t in reversed(stay):
                self.push(t.tag, False, t.own)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.close(i, keep_inline=tag in _BLOCK)
                return
            if self.stack[i].tag in _SCOPES and tag not in _BLOCK | {"html", "body"}:
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            self.pieces += len(data)
            if any(t.tag == "a" for t in self.stack[-3:]):
                self.linked += len(data)


_SCOPES = {"article", "body", "html", "main", "section", "nav", "table"}


def blocks(html: str) -> list[tuple[str, int, int, int]]:
    """(text, marks of the elements around, linked characters, characters) of the leaf blocks of a page, in page order."""
    parser = Blocks()
    parser.feed(html)
    HTMLParser.close(parser)
    parser.flush()
    return parser.out


_STOPS, _DIGITS = ".!?:;,…。", "0123456789"
#: Words of notices and legal lines.
_LEGAL = ("©", "(c)", "copyright", "all rights reserved", "cookie", "privacy", "terms of", "subscribe", "newsletter", "sign in", "sign up", "login", "log in", "share", "advert", "sponsor")
_TEXT = 14
_OWN = len(_PLACE) + _TEXT
WIDTH = 3 * _OWN + 3


def describe(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Features of the blocks of a page: elements and hints on the path, the whole text itself, and both for the blocks around."""
    own = np.zeros((len(found), _OWN))
    marks = np.asarray([b[1] for b in found], dtype=np.uint64)
    own[:, : len(_PLACE)] = (marks[:, None] >> np.arange(len(_PLACE), dtype=np.uint64)) & np.uint64(1)
    for i, (text, _, linked, pieces) in enumerate(found):
        n, n_words = len(text), text.count(" ") + 1
        stops, legal, digits = (sum(map(x.count, y)) for x, y in ((text, _STOPS), (text.lower(), _LEGAL), (text, _DIGITS)))
        own[i, len(_PLACE) :] = (
            1,
            min(n_words, 60) / 20,
            n_words < 3,
            n_words < 8,
            n_words > 20,
            min(1.0, linked / max(1, pieces)),
            linked > 0.5 * pieces,
            text[-1] in ".!?…\"'”»:",
            min(stops / n_words, 0.5) * 4,
            min(1.0, 8 * legal / n_words),
            text.isupper(),
            min(1.0, digits / n * 4),
            i < 3,
            i >= len(found) - 2,
        )
    zero = np.zeros((1, _OWN))
    if not len(found):
        return np.zeros((0, WIDTH))
    at = np.arange(len(found))
    return np.column_stack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero]), at == 0, at == len(found) - 1, np.ones(len(found))])


#: Letters of invented words, so that the field learns from elements and form, and not from a vocabulary.
_SYLLABLES = "ba ce di fo gu ha ke li mo nu pa re si to vu za en ar il om un tel mar son ver ing ly est".split()


def labelled_pages(n: int = 400, seed: int = 5) -> Iterator[list[tuple[str, int]]]:
    """Pages as lists of (markup, label): 1 marks markup of the main text, 0 anything else. Layouts and names vary by a fixed draw."""
    draw = random.Random(seed)
    pick, chance = draw.choice, draw.random

    def some_words(low: int, high: int) -> str:
        out = ["".join(pick(_SYLLABLES) for _ in range(draw.randint(1, 4))) for _ in range(draw.randint(low, high))]
        return " ".join(out)

    def prose(low: int = 1, high: int = 6) -> str:
        if chance() < 0.12:
            return (some_words(1, 4).capitalize() + pick([".", "", "!"])).replace(" ", pick([" ", "%%% ", " "]))
        text = " ".join(some_words(2, 14).capitalize() + pick([".", ".", ".", "?", "!"]) for _ in range(draw.randint(low, high)))
        if chance() < 0.1:
            text = " ".join(w + pick(["***", "###", "%%%", "&amp;&amp;&amp;", "$$$"]) for w in text.split())
        return text.upper() if chance() < 0.03 else text.replace(" ", pick([" ", " ", " | "]) if chance() < 0.05 else " ")

    def attribute(names: list[str]) -> str:
        return f' {pick(["class", "class", "id"])}="{pick(names)}"' if names and chance() < 0.85 else ""

    def links(k: int) -> str:
        items = [f'<a href="/{some_words(1, 1)}">{some_words(1, 3)}</a>' for _ in range(k)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if chance() < 0.8 else pick([" | ", " ", "<br>"]).join(items)

    def boiler(kind: str) -> str:
        if kind == "menu":
            tag = pick(["nav", "nav", "div", "ul"])
            return f"<{tag}{attribute(['nav', 'main-menu', 'navbar', 'breadcrumb', 'menu', 'toc'] if tag != 'nav' or chance() < 0.4 else [])}>{links(draw.randint(3, 9))}</{tag}>"
        if kind == "head":
            tag = pick(["header", "header", "div"])
            return f"<{tag}{attribute(['header', 'masthead', 'site-header', 'branding', 'top-banner'])}><a href='/'>{some_words(1, 3)}</a><p>{some_words(2, 7)}</p></{tag}>"
        if kind == "foot":
            tag = pick(["footer", "footer", "footer", "div"])
            own = attribute(["footer", "site-footer", "copyright", "legal"]) if tag == "div" or chance() < 0.4 else ""
            return f"<{tag}{own}>" + pick([f"&copy; {pick(['', '2024 '])}{some_words(1, 2)}.example &middot; {prose(1, 2)}", f"<p>{prose(1, 2)}</p>{links(3)}", f"Copyright 2021 {some_words(1, 3)}. All rights reserved."]) + f"</{tag}>"
        if kind == "side":
            tag = pick(["aside", "aside", "div", "section"])
            own = attribute(["sidebar", "related", "widget", "recommended", "side-rail", "trending", "related-articles"]) or (' class="sidebar"' if tag != "aside" else "")
            return f"<{tag}{own}><h3>{some_words(1, 4)}</h3>" + pick([links(draw.randint(2, 6)), f"<p>{prose(1, 4)}</p>", f"<p>{prose(1, 2)}</p><p>{prose(1, 2)}</p>"]) + f"</{tag}>"
        if kind == "advert":
            return f'<{pick(["div", "div", "aside", "section"])} class="{pick(["ad", "ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement"])}">{pick([prose(1, 3), f"<p>{prose(1, 3)}</p>", some_words(2, 6)])}</div>'
        if kind == "notice":
            return f'<div {pick(["class", "id"])}="{pick(["cookie-banner", "cookie-notice", "notice", "consent", "newsletter-signup", "alert", "gdpr", "popup", "subscribe"])}"><p>{prose(1, 3)}</p>{pick(["", "<button>" + some_words(1, 2) + "</button>"])}</div>'
        if kind == "form":
            return f'<form action="/{some_words(1, 1)}"><label>{some_words(1, 3)}</label><input type="text"><p>{prose(1, 2)}</p><select><option>{some_words(1, 1)}</option></select><button>{some_words(1, 2)}</button></form>'
        if kind == "comment":
            tag = pick(["section", "div", "div", "ol"])
            item = pick(["div", "article", "li", "p"])
            own = pick([' class="comments"', ' id="comments"', ' class="comment-list"', ' id="disqus_thread"', ' class="reader-comments"', ' class="replies"'])
            made = "".join(f'<{item} class="{pick(["comment", "comment", "reply", "c-item"])}">' + pick([f"<p>{prose(1, 4)}</p>", f"<b>{some_words(1, 2)}</b> {prose(1, 3)}", prose(1, 3)]) + f"</{item}>" for _ in range(draw.randint(1, 5)))
            return f"<{tag}{own}>{pick(['', f'<h2>{some_words(1, 3)}</h2>'])}{made}</{tag}>"
        return f'<div class="{pick(["share", "social", "byline", "tags", "post-meta", "author"])}">{pick([links(3), some_words(2, 6)])}</div>'

    def body(rich: bool) -> list[str]:
        out = [f"<{pick(['h1', 'h1', 'h1', 'h2'])}>{prose(1, 1)}</h1>"] if chance() < 0.92 else []
        for _ in range(draw.randint(1, 14)):
            kind = chance()
            if kind < 0.72 or not rich:
                out.append(f"<p>{prose()}</p>" if chance() < 0.8 else f"<p><b>{prose()}<br>")
            elif kind < 0.79:
                out.append(f"<h{(h := draw.randint(2, 3))}>{some_words(1, 6)}</h{h}>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{some_words(2, 12)}{pick(['.', ''])}</li>" for _ in range(draw.randint(2, 5))) + "</ul>")
            elif kind < 0.89:
                out.append(f"<blockquote>{prose()}</blockquote>")
            elif kind < 0.92:
                out.append(f"<pre>{some_words(3, 12)}</pre>")
            elif kind < 0.96:
                out.append("<table>" + "".join(f"<tr><td>{some_words(1, 3)}</td><td>{some_words(1, 4)}</td></tr>" for _ in range(draw.randint(1, 4))) + "</table>")
            else:
                out.append(f"<p>{some_words(3, 9)} <a href='/x'>{some_words(1, 4)}</a> {prose(1, 3)}</p>")
        return out

    for _ in range(n):
        page: list[tuple[str, int]] = [(f"<html><head><title>{some_words(2, 6)}</title><style>p{{}}</style></head><body>", 0)]
        for kind in ("menu", "head", "notice", "advert", "menu", "form", "share", "side"):
            if chance() < {"menu": 0.6, "head": 0.5, "advert": 0.5}.get(kind, 0.2):
                page.append((boiler(kind), 0))
        opened, closed = pick([("<article>", "</article>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), (f'<div class="{pick(["content", "post-body", "entry-content", "article", "story", "main-text"])}">', "</div>"), ("<div>", "</div>"), (f'<div id="{pick(["main", "content", "article"])}"><section>', "</section></div>")])
        page.append((opened, 0))
        for piece in body(chance() < 0.6):
            page.append((piece, 1))
            if chance() < 0.05:
                page.append((boiler(pick(["advert", "advert", "side", "share", "notice", "form"])), 0))
        if chance() < 0.2:
            page.append((boiler("comment"), 0))
        page.append((closed, 0))
        for kind in ("share", "comment", "side", "advert", "form", "notice", "menu"):
            if chance() < 0.22:
                page.append((boiler(kind), 0))
        if chance() < 0.85:
            page.append((boiler("foot"), 0))
        page.append(("</body></html>", 0))
        yield page


@functools.cache
def trained(n: int = 400) -> crf.Model:
    """The field fitted on labelled_pages(); the same on every call."""
    xs, ys, number = [], [], []
    for page in labelled_pages(n):
        parser, labels = Blocks(), []
        for markup, label in page:
            before = len(parser.out)
            parser.feed(markup)
            if label or not parser.text:
                pass
            # What the piece leaves open (a p without an end) is its own block, ended by the next piece.
            held = parser.out[before:]
            labels += [None] * len(held)
            for i in range(len(labels) - len(held), len(labels)):
                labels[i] = label
            pending = label if "".join(parser.text).strip() else None
            if pending is not None:
                count = len(parser.out)
                parser.flush()
                labels += [label] * (len(parser.out) - count)
        xs.append(describe(parser.out))
        ys.append(np.asarray(labels, dtype=np.int64))
        number.append(len(parser.out))
    return crf.fit(np.concatenate(xs), np.concatenate(ys), np.asarray(number), penalty=2.0, steps=120)


def extract(pages: list[str], model: crf.Model) -> list[str]:
    """The main text of every page: its blocks that Viterbi decoding labels as such, joined by line ends."""
    found = [blocks(html) for html in pages]
    number = np.asarray([len(f) for f in found], dtype=np.int64)
    if not number.sum():
        return [""] * len(pages)
    x = np.concatenate([describe(f) for f in found])
    labels = crf.viterbi(x @ model.weights, model, crf.Chains(number))
    ends = np.cumsum(number)
    return ["\n".join(b[0] for b, y in zip(f, labels[e - k : e].tolist(), strict=True) if y) for f, e, k in zip(found, ends.tolist(), number.tolist(), strict=True)]


def extract_pages(pages: DataFrame, html: str = "html", text: str = "text", chunk: int = 64) -> DataFrame:
    """`pages` with the column `text` in place of `html`: the main text of each page, and n_chars, its code points.

    The page is cut to leaf blocks; a linear-chain conditional random field labels them by the elements around, hints
    in class and id names, the form of the text and the blocks beside, and Viterbi decoding picks the main ones.
    Scripts, styles, hidden elements and the fields of forms (textarea, select) give no blocks; formulas, drawings and
    fallbacks (math, svg, object, noscript) are text like any other. Character references are decoded, white space in a block
    becomes one space, blocks are joined by one \\n. The field is fitted on generated labelled pages, on the driver.

    Null pages are empty; an empty page, or one without blocks, has the empty text. Every row is extracted by itself, so
    repeated rows and null ids are kept as they are; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(trained())
    kept = [c for c in pages.columns if c not in (html, text, "n_chars")]
    source = pages.select(*kept, F.col(html).cast("string").alias(html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                part = batch.slice(at, chunk)
                got = extract([x or "" for x in part.column(len(kept)).to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=[*kept, text, "n_chars"])

    return source.mapInArrow(run, StructType([source.schema[c] for c in kept]).add(text, "string").add("n_chars", "long"))
