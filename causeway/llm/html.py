"""Main text of web pages as the maximum-scoring contiguous region.

A page becomes a row of tags and text runs. Words score positive, except inside elements whose tag,
class, id or role labelled pages show to hold boilerplate; tags score negative, by how seldom they
stand inside main text. Weights are log-odds learned from labelled pages. Boilerplate inside the content
root (article, main, or else a container that labelled pages show to hold main text) is left out, but
scores nothing, however long, so it parts no text; on pages without a root it costs at most BOX. One
linear scan finds the region of the highest sum; its runs outside boilerplate are the text.

Character references are decoded after the markup is read, white space becomes one space, blocks are
joined by one space in page order. Inline tags don't part words.

A root's own class, id and role don't make it boilerplate on pages where they would leave no root.
Within a root, a name with as many words that labelled pages never use as boilerplate words (``share-price-table``)
may speak of the topic: it counts where most words inside are links. An article beside a larger one, less than
TEASER of its length, that opens with a link is a teaser.

Defined results: null or empty html, and pages without a positive word, give an empty text; an empty table gives an empty result. Broken
markup (unclosed or stray tags, a page that ends inside a tag, comment or script) is read as far as it
goes. Pages are read whole, in time linear in their length, however deep. Ties: of regions with equal sums the first and shortest. Repeated rows are read each on its own. Further columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import map_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose text never shows or is a control.
SILENT = frozenset("button canvas datalist head iframe math noembed noframes noscript object option select svg template textarea title".split())
MAIN = frozenset(["article", "main"])
#: Most that boilerplate between two runs of text costs on a page without a content root.
BOX = 10.0

#: Of the longest article's words: a shorter article that opens with a link only points to its story.
TEASER = 1 / 3

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|</?(?P<odd>[a-z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.I | re.S,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")
#: Parts of a name that may be words: not next to digits, as in generated names.
_WORD = re.compile(r"(?<![a-z0-9])[a-z]{3,}(?![a-z0-9])")


def _marks(tag: str, attrs: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """What is known of an element: tag and parts of its class, id and role; and those names of several words."""
    out, names = [tag], []
    if attrs and not attrs.isspace():
        for m in _NAMED.finditer(attrs):
            value = (m[2] or m[3] or m[4] or "").lower()
            out += [f".{x}" for x in _PART.findall(value)]
            names += value.split()
        if _HIDDEN.search(attrs):
            out.append(".hidden")
    return tuple(out), tuple(names)


class Element:
    """An open element; what holds for it and all around it is worked out once, from its parent, so deep pages cost no more than flat ones."""

    __slots__ = ("article", "known", "lead", "link", "linked", "marks", "names", "parent", "tag", "teaser", "words")

    def __init__(self, tag: str, marks: tuple[tuple[str, ...], tuple[str, ...]], parent: Element | None):
        self.tag, (self.marks, self.names), self.parent, self.known = tag, marks, parent, None
        #: Whether it is, or is in, a link; its words and those of them in links; place of its first text, and whether that is a link.
        self.link = tag == "a" or (parent is not None and parent.link)
        self.words, self.linked, self.lead, self.teaser = 0, 0, None, False
        self.article = parent and (parent if parent.tag == "article" else parent.article)

    def line(self) -> Iterator[Element]:
        """Itself and what is around it, inside out."""
        at: Element | None = self
        while at:
            yield at
            at = at.parent


def pieces(page: str) -> Iterator[tuple[str, str, Element | None]]:
    """("text", run, innermost open element) and ("tag", name, the same, its own for a start tag) in page order. Silent elements' text is left out."""
    open_: list[Element] = []
    count: Counter = Counter()
    silent = 0
    at = 0

    def close() -> None:
        nonlocal silent
        e = open_.pop()
        count[e.tag] -= 1
        silent -= e.tag in SILENT

    for m in _PIECE.finditer(page):
        if m.start() > at and not silent:
            yield "text", page[at : m.start()], open_[-1] if open_ else None
        at = m.end()
        tag = m["tag"] or m["odd"]
        if not tag:
            continue
        tag, inside = tag.lower(), open_[-1] if open_ else None
        if m["end"] or (m["odd"] and m[0].startswith("</")):
            if count[tag]:
                while open_[-1].tag != tag:
                    close()
                close()
        elif tag == "body":
            open_, count, silent = [], Counter(), 0
        elif tag not in VOID and not (m["attrs"] or "").rstrip().endswith("/"):
            if tag in ("p", "li", "option") and open_ and open_[-1].tag == tag:
                close()
            inside = Element(tag, _marks(tag, m["attrs"] or ""), open_[-1] if open_ else None)
            open_.append(inside)
            count[tag] += 1
            silent += tag in SILENT
        yield "tag", tag, inside
    if len(page) > at and not silent:
        yield "text", page[at:], open_[-1] if open_ else None


def measure(items: list[tuple[str, str, Element | None]]) -> None:
    """Words, link words and first text of every element, what is inside it included; then which articles are teasers."""
    opened = list(dict.fromkeys(e for kind, _, e in items if kind == "tag" and e))  # an element comes after those around it
    for i, (kind, x, e) in enumerate(items):
        if kind == "text" and e and (n := len(x.split())):
            e.words += n
            e.linked += n * e.link
            e.lead = e.lead or (i, e.link)
    for e in reversed(opened):
        if e.parent and e.words:
            e.parent.words += e.words
            e.parent.linked += e.linked
            e.parent.lead = min(filter(None, (e.parent.lead, e.lead)))
    own = {e: e.words for e in opened if e.tag == "article"}
    for e in own:
        if e.article in own:
            own[e.article] -= e.words
    longest = max(own, key=own.get, default=None)
    around = set(longest.line()) if longest else ()
    for e in own:
        e.teaser = e not in around and e.lead is not None and e.lead[1] and e.words < TEASER * own[longest]


@dataclass(frozen=True)
class Weights:
    """word: of a word outside boilerplate. marks: log-odds of main text, negative ones only. tags: penalties. outside: of words outside the main element of a page that has one. roots: classes and ids of containers of main text. seen: all marks of labelled pages."""

    word: float
    outside: float
    marks: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    roots: frozenset[str] = frozenset()
    seen: frozenset[str] = frozenset()

    def _topical(self, name: str) -> bool:
        """Whether a name has as many words unknown to labelled pages as boilerplate words."""
        parts = [f".{x}" for x in _WORD.findall(name)]
        strange = sum(x not in self.seen and x.removesuffix("s") not in self.seen for x in parts)
        return 0 < sum(f".{x}" in self.marks for x in _PART.findall(name)) <= strange

    def worst(self, e: Element, within: bool) -> float:
        """The worst mark of an element itself."""
        got = [w for k in e.marks if (w := self.marks.get(k, 0.0)) < 0]
        if got and within and e.names and 2 * e.linked < e.words and any(map(self._topical, e.names)):
            clear = [f".{x}" for name in e.names if not self._topical(name) for x in _PART.findall(name)]
            got = [w for k in (e.tag, *clear, *(k for k in e.marks if k == ".hidden")) if (w := self.marks.get(k, 0.0)) < 0]
        return min(got, default=0.0) if not e.teaser else min([*got, -1.0])

    def is_root(self, e: Element, has_main: bool) -> bool:
        """Whether an element, were it the outermost such, is the content root."""
        return e.tag in MAIN if has_main else not self.roots.isdisjoint(e.marks)

    def state(self, e: Element | None, has_main: bool, trusting: bool) -> tuple[float, bool, float]:
        """Of an element and those around it: the worst mark; whether there is a root; the worst mark up to the root. ``trusting``: a root's own marks don't count."""
        if e is None:
            return 0.0, False, 0.0
        todo = []
        at: Element | None = e
        while at and at.known is None:
            todo.append(at)
            at = at.parent
        worst, rooted, at_root = at.known if at else (0.0, False, 0.0)
        for x in reversed(todo):
            begins = not rooted and self.is_root(x, has_main)
            if not (begins and trusting):
                worst = min(worst, self.worst(x, rooted))
            if begins:
                rooted, at_root = True, worst
            x.known = worst, rooted, at_root
        return e.known

    def context(self, e: Element | None, has_main: bool, trusting: bool) -> tuple[float, bool, bool]:
        """Of a word: its score in the scan; whether it is boilerplate; whether that lies within a content root."""
        worst, rooted, at_root = self.state(e, has_main, trusting)
        if has_main and not rooted:
            worst = min(worst, self.outside)
        if worst >= 0:
            return self.word, False, False
        within = rooted and at_root >= 0
        return 0.0 if within else worst, True, within


def _has_main(items) -> bool:
    return any(kind == "tag" and x in MAIN for kind, x, _ in items)


def learn(pages: Iterable[tuple[str, str]]) -> Weights:
    """pages: html and main text. Log-odds of words by mark, and of tags by whether main text goes on after them."""
    good, bad, inside, outside, away, seen = Counter(), Counter(), Counter(), Counter(), [0, 0], set()
    for page, main in pages:
        main = f" {' '.join(main.split())} "
        items = list(pieces(page))
        has_main, last = _has_main(items), False
        for kind, x, around in items:
            if kind == "tag":
                (inside if last else outside)[x] += 1
                seen.update(around.marks if around else ())
                continue
            words = references.unescape(x).split()
            if not words:
                continue
            last = f" {' '.join(words)} " in main
            line = list(around.line()) if around else []
            for mark in {y for e in line for y in e.marks}:
                (good if last else bad)[mark] += len(words)
            if has_main and not any(e.tag in MAIN for e in line):
                away[not last] += len(words)
    odds = lambda g, b: log((g + 1) / (b + 1))
    marks = {m: w for m in good | bad if (w := odds(good[m], bad[m])) < -1}
    tags = {t: min(-0.05, odds(inside[t], outside[t]) / 2) for t in inside | outside}
    roots = frozenset(m for m in good if m.startswith(".") and odds(good[m], bad[m]) > 1)
    return Weights(1.0, min(-1.0, odds(*away)), marks, tags, roots, frozenset(seen))


def region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of the highest positive sum, the first and shortest among equals; (0, 0) if none is positive."""
    best, bounds, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, bounds = total, (start, i + 1)
    return bounds


def main_text(page: str, weights: Weights) -> str:
    items = list(pieces(page))
    measure(items)
    has_main, scores, shown, spent = _has_main(items), [], [], 0.0
    states = [weights.state(around, has_main, False) for kind, _, around in items if kind == "text"]
    rooted = has_main or any(x[1] for x in states)
    trusting = rooted and not any(x[1] and x[2] >= 0 for x in states)  # marks speak against every root: then they mean something else
    if trusting:
        for _, _, around in items:
            for e in around.line() if around else ():
                if e.known is None:
                    break
                e.known = None
    for kind, x, around in items:
        s, boilerplate, within = weights.context(around, has_main, trusting)
        if kind == "tag":
            s = 0.0 if within else weights.tags.get(x, -0.5)
        else:
            s *= len(x.split())
        if boilerplate and not rooted:
            s = max(s, spent - BOX)
            spent -= s
        elif kind == "text" and not boilerplate and s > 0:
            spent = 0.0
        scores.append(s)
        shown.append(not boilerplate)
    first, last = region(scores)
    out = []
    for (kind, x, _), show in zip(items[first:last], shown[first:last], strict=True):
        if kind == "text":
            if show:
                out.append(references.unescape(x))
        elif x not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def labelled_pages() -> list[tuple[str, str]]:
    """Pages with known main text, made from common layouts: the default training set."""
    text = "the committee met on monday and agreed to publish its findings before the end of the year"
    more = "several members asked for further evidence and the chair promised a written answer"
    side = ["home about contact", "read this next today", "we use small files to remember you"]
    boiler_tags = ["nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"]
    boiler_marks = (
        "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
        "sidebar side rail widget related recommended recommendations trending share sharing social follow comment comments commentlist reply replies respond discussion disqus "
        "menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead topbar footer copyright legal newsletter subscribe subscription signup login "
        "search form toolbar hidden skip contentinfo complementary navigation dialog paywall outbrain taboola "
        "colophon thoughts reactions feedback"
    ).split()
    layout = (
        "area author bar block body bottom box boxes button buttons card cards col column container desktop entry fixed grid group head heading holder icon icons image inline inner item items "
        "label layout left link links list main message mobile module more outer page panel post posts reader readers region right row section site slot small sticky story stories text thread title top unit wide wrap wrapper zone"
    )
    boxes = [(f"<{t}>", f"</{t}>") for t in boiler_tags] + [(f'<div class="{m}">', "</div>") for m in boiler_marks]
    shells = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="story">', "</div>")]
    out = []
    for k, (left, right) in enumerate(boxes):
        a, b = shells[k % len(shells)]
        words = side[k % len(side)]
        box = f"{left}<ul><li><a href='/x'>{words}</a></li></ul><p>{words}</p>{right}"
        body = f"<h1>{text}</h1><p>{text} <b>{more}</b> <a href='/y'>{more}</a></p><ul><li>{more}</li></ul><blockquote><p>{text}</p></blockquote><h2>{more}</h2><p>{more}<br>{text}</p>"
        main = f"{text} {text} {more} {more} {more} {text} {more} {more} {text}"
        first, last = (box, "") if k % 3 == 0 else ("", box)
        within = box if k % 3 == 2 else ""
        links = f"<div class='{layout}'></div><div><ul><li><a href='/z'>{side[0]}</a></li></ul></div>"
        out.append((f"<html><head><title>x</title></head><body>{links}{first}{a}{body}{within}{body}{b}{last}{links}</body></html>", f"{main} {main}"))
    return out


def extract(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """The id columns, ``text`` and ``n_chars`` of every page. No shuffle."""
    weights = weights or learn(labelled_pages())

    def run(batches):
        for b in batches:
            got = [main_text(x, weights) if x else "" for x in b.column(len(id_cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(id_cols)], pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=[*id_cols, "text", "n_chars"])

    ids = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in id_cols)
    return map_batches(pages.select(*[F.col(c) for c in id_cols], F.col(html_col)), run, f"{ids}, text string, n_chars bigint")
