"""Main text of HTML pages from flat text blocks and a decision tree.

A page is cut at block-level tags into a flat list of text blocks. Each block is described by its words and link
density, those of the block before and after it, and by weak signs of its place: whether it stands in a content element,
in an element that is boilerplate by its tag or role, how far class names speak of boilerplate (a share), whether it is a
heading, and whether the page has a content element at all. A decision tree grown on the small labelled table below tells
main text from the rest; the blocks it takes are joined in page order. Names alone don't settle a block: a share of
one half or less counts by the block's words and links.

A page is one row and stays one: no shuffle, no state between rows. Null or empty html gives an empty text, malformed
html is read as far as it goes, and time is in proportion to a page's length whatever its nesting (every element is
opened and closed once; end tags that close nothing are skipped by a count). Rows that repeat a page_id stay rows of
their own. Extra columns are left alone, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol option p pre section "
    "select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What changes nothing for what stands in it.
PLAIN_TAGS = frozenset("b i em strong span u s small big sub sup font code kbd samp tt mark cite q abbr time ins del".split())
#: Text in these is never shown as text.
SILENT_TAGS = frozenset("head title script style template noscript iframe object svg math canvas audio video select option textarea button datalist".split())
MARKED_TAGS = frozenset("nav footer aside form header menu dialog".split())
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT_TAGS = frozenset("article main".split())
CONTENT_NAMES = frozenset("articlebody entry-content post-content article-body article-content post-body story-body main-content maincontent".split())
#: Words of class names and ids: boilerplate, boilerplate or not, the article, the layout, and those that turn the rest around.
NOISE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promotion sidebar menu submenu nav "
    "navbar navigation breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login sharing comment comments commentlist respond replies disqus related recommended recommendations pagination "
    "pager widget widgets toolbar copyright disclaimer teaser teasers".split()
)
WEAK_WORDS = frozenset("header banner notice notices notification side social share search form skip reply privacy".split())
OWN_WORDS = frozenset("article post entry story content main body text blog news".split())
LAYOUT_WORDS = frozenset("list box wrap wrapper container section area block top bottom left right inner outer item items bar links link site page global unit slot row col column".split())
TURNING_WORDS = frozenset("has no with without not hide".split())
#: Boilerplate that also holds for content elements inside it (a comment may be an article of its own).
DEEP_WORDS = frozenset("comment comments commentlist replies respond disqus sidebar related recommended ad ads advert advertisement sponsored teaser teasers".split())
DEEP_TAGS = frozenset("aside footer nav".split())
_CLOSES_P = BLOCK_TAGS - {"br", "option", "button", "select", "textarea", "iframe", "noscript"}
#: What an element's start closes if it is open in the same list or table, and what starts a new one.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table select menu".split())
_P_SCOPES = frozenset("table td th caption button object".split())
_SPLIT = re.compile(r"[^a-z0-9]+")


def name_noise(names: list[str]) -> float:
    """How far class names speak of boilerplate, from 0 to 1: the share of such words in the name that says so most."""
    most = 0.0
    for name in names:
        words = [w for w in _SPLIT.split(name) if w]
        if TURNING_WORDS.intersection(words):
            continue
        strong, weak = sum(w in NOISE_WORDS for w in words), sum(w in WEAK_WORDS for w in words)
        own = sum(w in OWN_WORDS for w in words)
        other = len(words) - strong - weak - own - sum(w in LAYOUT_WORDS for w in words)
        if strong or weak and not own:
            most = max(most, (strong + weak / 2) / (strong + weak + other))
    return most


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    link_parts: list[str] = field(default_factory=list)
    content: bool = False
    marked: bool = False
    noise: float = 0.0
    heading: bool = False
    text: str = ""

    def close(self) -> bool:
        self.text = " ".join("".join(self.parts).split())
        return bool(self.text)

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1

    @property
    def link_density(self) -> float:
        linked = len(" ".join("".join(self.link_parts).split()))
        return min(1.0, linked / len(self.text))


@dataclass(slots=True)
class _Open:
    """An open element with what holds inside it."""

    tag: str = ""
    content: bool = False
    marked: bool = False
    noise: float = 0.0
    deep: bool = False
    silent: bool = False
    link: bool = False
    heading: bool = False
    p: bool = False
    items: tuple = ()


#: Openings of markup and what closes it; how many that nothing closes are left for the parser, which looks for each one's end.
_OPENINGS = (("<!--", "-->"), ("<![", "]>"), ("<", ">"))
_UNCLOSED = 16


def closed(html: str) -> str:
    """html without the surplus of openings that nothing after them closes, so that a broken page takes time in proportion to its length."""
    for opening, closing in _OPENINGS:
        at = html.rfind(closing) + 1
        while at < len(html) and html.count(opening, at) > _UNCLOSED:
            for _ in range(_UNCLOSED):
                at = html.index(opening, at) + len(opening)
            html = html[:at] + html[at:].replace(opening, "")
    return html


class _Blocks(HTMLParser):
    """Flat blocks of a page in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[_Open] = [_Open()]
        self.open: Counter = Counter()
        self.block = Block()
        self.has_content = False

    def _cut(self) -> None:
        if self.block.parts and self.block.close():
            self.blocks.append(self.block)
        self.block = Block()

    def _pop(self, *tags: str) -> None:
        """Close the innermost open element of these tags, and all in it."""
        while (gone := self.stack.pop()).tag not in tags:
            self.open[gone.tag] -= 1
        self.open[gone.tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self._cut()
        if tag in _CLOSES_P and self.stack[-1].p:
            self._pop("p")
        closes = [t for t in _CLOSES.get(tag, ()) if t in self.stack[-1].items]
        if closes:
            self._pop(closes[-1])
        if tag in VOID_TAGS:
            return
        top = self.stack[-1]
        self.open[tag] += 1
        if not attrs and tag in PLAIN_TAGS:
            self.stack.append(_Open(tag, top.content, top.marked, top.noise, top.deep, top.silent, top.link, top.heading, top.p, top.items))
            return
        marks = {k: (v or "").lower() for k, v in attrs}
        names = f"{marks.get('class', '')} {marks.get('id', '')}".split()
        noise = name_noise(names) if names else 0.0
        deep = top.deep or tag in DEEP_TAGS or noise > 0.5 and any(DEEP_WORDS.intersection(_SPLIT.split(n)) for n in names)
        role = marks.get("role")
        content, marked = top.content, top.marked
        if tag in CONTENT_TAGS or role in ("main", "article") or CONTENT_NAMES.intersection(names) or marks.get("itemprop") == "articlebody":
            content = self.has_content = True
            if deep:
                marked, noise = True, max(noise, top.noise)
            else:
                marked, noise = False, noise
        elif tag in ("html", "body"):
            noise = top.noise
        else:
            hidden = "hidden" in marks or marks.get("aria-hidden") == "true" or "display:none" in marks.get("style", "").replace(" ", "")
            marked = marked or tag in MARKED_TAGS and not (tag == "header" and content) or role in MARKED_ROLES or hidden
            noise = max(noise, top.noise)
        items = () if tag in _SCOPES else top.items
        if tag in _CLOSES and tag not in items:
            items = (*items, tag)
        inside = _Open(tag, content, marked, noise, deep, top.silent or tag in SILENT_TAGS, top.link or tag == "a", top.heading or tag in HEADINGS, tag == "p" or top.p and tag not in _P_SCOPES, items)
        self.stack.append(inside)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self._cut()
        if self.open[tag]:
            self._pop(tag)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.silent:
            return
        if not self.block.parts:
            self.block.content, self.block.marked, self.block.noise, self.block.heading = top.content, top.marked, top.noise, top.heading
        self.block.parts.append(data)
        if top.link:
            self.block.link_parts.append(data)

    def run(self, html: str) -> list[Block]:
        self.feed(closed(html))
        self.close()
        self._cut()
        return self.blocks


def page_blocks(html: str) -> tuple[list[Block], bool]:
    parser = _Blocks()
    return parser.run(html), parser.has_content


COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "content", "marked", "noise", "heading", "page_content")


def features(blocks: list[Block], has_content: bool) -> np.ndarray:
    """One row for each block, in the order of COLUMNS; a missing neighbour counts as an empty one."""
    own = np.array([(b.words, b.link_density) for b in blocks], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    where = np.array([(b.content, b.marked, b.noise, b.heading, has_content) for b in blocks], float).reshape(-1, 5)
    return np.concatenate([own, np.concatenate([edge, own])[:-1], np.concatenate([own, edge])[1:], where], 1)


#: Labelled blocks, made up for this module: the columns of COLUMNS, then 1 for main text.
LABELLED = """
12 0 0 0 85 0 1 0 0 1 1 1
6 0 0 0 40 0 1 0 0 1 1 1
85 0 12 0 60 0 1 0 0 0 1 1
60 .05 85 0 3 0 1 0 0 0 1 1
3 0 60 .05 44 0 1 0 0 1 1 1
1 0 33 0 0 0 1 0 0 0 1 1
2 0 1 0 9 0 1 0 0 0 1 1
44 .3 3 0 10 0 1 0 0 0 1 1
10 0 44 .3 18 1 1 0 0 0 1 1
9 .6 70 0 52 0 1 0 0 0 1 1
5 1 64 .1 90 0 1 0 0 0 1 1
25 .9 40 0 31 0 1 0 0 0 1 1
3 1 4 1 4 1 1 0 0 0 1 1
140 0 5 0 1 0 1 0 0 0 1 1
4 0 0 0 0 0 1 0 0 0 1 1
2 1 60 0 80 0 1 0 0 0 1 1
1 1 15 0 35 0 1 0 0 0 1 1
50 0 2 1 60 0 1 0 0 0 1 1
7 0 2 1 70 0 1 0 0 1 1 1
1 1 1 1 1 1 1 1 0 0 1 0
3 1 2 1 4 1 1 1 .5 0 1 0
40 0 12 0 50 0 1 1 0 0 1 0
18 .2 80 0 66 0 1 1 0 0 1 0
7 0 75 0 120 0 1 1 0 0 1 0
55 0 20 0 48 0 1 1 0 0 1 0
5 0 8 0 4 1 1 0 1 1 1 0
90 0 40 0 70 0 1 0 1 0 1 0
33 0 60 0 45 0 1 0 .75 0 1 0
8 0 30 0 55 0 1 0 1 0 1 0
2 1 25 0 3 1 1 0 .5 0 1 0
6 1 31 0 28 0 1 0 .5 0 1 0
12 .8 44 0 52 0 1 0 .5 0 1 0
3 0 52 0 2 1 1 0 .5 0 1 0
4 0 40 0 0 0 1 0 .5 0 1 0
9 0 0 0 60 0 1 0 .5 1 1 1
5 0 0 0 33 0 1 0 .5 1 1 1
30 0 8 0 45 0 1 0 .5 0 1 1
70 .1 30 0 25 0 1 0 .5 0 1 1
14 0 40 0 60 0 1 0 .5 0 1 1
6 0 35 0 40 0 1 0 .17 0 1 1
22 .2 18 0 60 0 1 0 .25 0 1 1
1 1 0 0 1 1 0 1 0 0 1 0
2 1 1 1 1 1 0 1 .5 0 1 0
1 1 1 1 8 0 0 1 0 0 1 0
8 0 1 1 12 0 0 0 1 0 1 0
30 0 1 1 9 0 0 0 1 0 1 0
14 .1 52 0 0 0 0 1 0 0 1 0
9 0 110 0 0 0 0 1 1 0 1 0
62 0 14 0 20 .5 0 1 0 0 1 0
11 0 0 0 7 1 0 0 0 0 1 0
48 0 6 0 10 0 0 0 0 0 1 0
26 .1 95 0 4 0 0 0 0 0 1 0
3 0 40 0 1 1 0 0 0 1 1 0
2 1 1 1 2 1 0 0 0 0 1 0
75 0 30 0 12 0 0 0 0 0 1 0
30 0 4 0 60 0 0 0 .5 0 1 0
12 0 1 1 25 0 0 0 0 0 1 0
80 0 0 0 90 0 0 0 0 0 1 0
9 .1 7 0 130 0 0 0 0 0 1 0
110 0 25 0 44 0 0 0 0 0 1 0
90 0 10 0 70 .02 0 0 0 0 0 1
70 .02 90 0 35 0 0 0 0 0 0 1
35 0 70 .02 80 0 0 0 0 0 0 1
22 .1 45 0 58 0 0 0 0 0 0 1
16 0 32 0 40 0 0 0 0 0 0 1
40 0 3 1 55 0 0 0 0 0 0 1
60 .1 8 0 2 1 0 0 0 0 0 1
24 0 5 0 31 0 0 0 0 0 0 1
5 0 62 0 77 0 0 0 0 0 0 1
3 0 40 0 66 .1 0 0 0 0 0 1
7 0 28 .1 35 0 0 0 0 0 0 1
8 0 2 1 64 0 0 0 0 1 0 1
9 0 0 0 51 0 0 0 0 1 0 1
4 0 49 0 88 0 0 0 0 1 0 1
120 .08 3 0 2 1 0 0 0 0 0 1
40 0 60 0 0 0 0 0 0 0 0 1
25 0 33 0 2 1 0 0 0 0 0 1
18 0 90 0 5 0 0 0 0 0 0 1
33 .1 0 0 0 0 0 0 0 0 0 1
15 0 0 0 0 0 0 0 0 0 0 1
28 0 45 0 60 0 0 0 .5 0 0 1
14 .4 30 0 45 0 0 0 0 0 0 1
6 .5 50 0 62 0 0 0 0 0 0 1
1 1 0 0 1 1 0 0 0 0 0 0
2 1 1 1 3 1 0 0 0 0 0 0
3 1 2 1 60 0 0 0 0 0 0 0
4 .8 5 1 2 1 0 0 0 0 0 0
6 0 1 1 2 1 0 0 0 0 0 0
7 0 2 1 3 1 0 0 0 0 0 0
12 0 3 1 2 1 0 0 0 0 0 0
30 .9 20 .9 14 1 0 0 0 0 0 0
18 .7 5 1 9 .5 0 0 0 0 0 0
14 .4 3 1 4 1 0 0 0 0 0 0
5 0 80 0 3 1 0 0 0 0 0 0
7 .2 66 0 0 0 0 0 0 0 0 0
6 0 0 0 2 1 0 0 0 1 0 0
4 0 2 1 3 1 0 0 0 1 0 0
2 0 0 0 1 1 0 0 0 0 0 0
5 0 3 1 4 0 0 0 0 0 0 0
40 0 10 0 66 0 0 1 0 0 0 0
12 .1 90 0 1 1 0 1 0 0 0 0
28 0 1 1 70 0 0 0 1 0 0 0
60 0 40 0 30 0 0 0 .75 0 0 0
8 .3 40 0 2 1 0 0 .5 0 0 0
3 1 30 0 40 0 0 0 .5 0 0 0
60 0 0 0 50 1 1 0 0 0 1 1
4 .6 2 0 50 0 0 0 0 0 1 0
20 0 10 .5 2 .5 1 1 0 0 1 0
20 0 50 1 2 .5 0 0 1 0 0 0
20 0 50 0 50 .5 0 0 0 0 1 0
60 0 50 .5 2 .5 1 0 .17 0 1 1
60 .2 50 .5 2 .5 0 0 0 1 1 0
9 .6 0 0 10 1 1 0 0 0 1 1
60 0 2 0 2 1 0 0 0 1 1 0
20 .2 10 0 2 0 0 1 0 0 0 0
60 0 50 0 2 1 1 0 .75 0 1 0
20 0 50 0 2 0 0 0 1 0 0 0
60 0 50 0 10 1 0 1 0 0 1 0
20 1 50 .5 2 1 0 0 0 1 1 0
20 .2 10 1 0 0 0 0 1 0 0 0
20 0 2 1 2 0 0 1 0 0 0 0
60 0 2 0 2 1 0 1 0 0 0 0
60 .2 0 0 10 1 0 0 0 0 1 0
20 0 2 1 6 0 0 0 0 0 0 0
25 0 1 1 20 0 0 0 0 0 0 0
18 .1 3 .9 9 0 0 0 0 0 0 0
9 0 70 0 25 0 0 0 0 0 0 1
12 0 55 0 22 0 0 0 0 0 0 1
8 0 61 .1 18 0 0 0 0 0 0 1
9 0 4 0 20 0 0 0 0 0 0 0
11 0 2 1 24 0 0 0 0 0 0 0
86 .7 86 0 36 0 1 0 .25 0 1 1
19 .1 77 .7 5 .8 0 1 0 0 0 0
8 .8 45 .3 79 .4 1 0 .17 0 1 1
68 .2 37 0 10 .6 1 0 1 1 1 0
60 0 88 1 3 0 1 1 0 0 1 0
69 .3 19 0 2 .5 1 0 .75 0 1 0
21 .4 13 .5 6 0 1 0 .25 0 1 1
4 0 9 .2 23 .7 1 0 0 0 1 1
8 0 73 .1 2 0 0 0 1 0 0 0
4 0 0 .2 5 .1 0 1 0 0 0 0
8 0 31 .1 13 .1 0 0 1 0 0 0
4 .9 60 0 17 0 0 1 0 0 0 0
4 0 29 0 19 .6 0 0 0 0 1 0
16 0 86 0 14 .6 0 0 0 0 1 0
19 0 8 .5 0 .6 0 0 0 1 1 0
3 .9 8 1 11 0 0 1 0 0 1 0
46 0 27 .4 4 0 0 1 0 0 0 0
54 0 30 0 0 0 0 0 1 0 0 0
4 0 58 0 18 0 0 1 0 0 0 0
4 0 75 .1 20 0 0 1 0 0 0 0
4 0 56 .1 13 0 0 0 0 0 1 0
65 0 63 .4 12 0 0 1 0 0 0 0
4 0 11 .4 5 0 0 0 0 0 1 0
33 .5 37 0 0 .8 0 0 0 1 1 0
4 .9 55 .1 5 .5 0 1 0 0 0 0
8 .3 25 0 20 0 0 0 1 0 0 0
11 .5 7 .1 19 .4 0 0 1 0 0 0
40 0 87 .1 0 .8 0 1 0 0 0 0
3 .5 62 0 12 0 0 1 0 0 1 0
12 .6 59 .1 4 0 0 0 0 0 1 0
7 .8 63 0 19 0 0 0 0 1 1 0
72 .1 86 .8 2 .8 0 0 1 0 0 0
4 0 61 .9 5 .3 0 1 0 0 0 0
20 0 10 .3 18 0 0 0 1 0 0 0
15 0 88 .8 13 0 0 0 1 0 0 0
33 0 34 .7 1 .7 0 1 0 0 1 0
24 .6 78 0 5 .8 0 0 1 0 0 0
68 0 89 0 14 .5 0 0 1 0 0 0
29 0 44 0 8 0 0 1 0 0 1 0
30 .5 54 0 18 .1 0 0 1 0 0 0
27 .9 42 .1 5 .5 0 1 0 0 0 0
10 .3 0 .4 0 .2 0 0 1 0 0 0
76 0 11 .1 20 0 0 0 1 0 0 0
84 0 49 0 1 0 0 0 1 0 0 0
44 0 9 0 0 .2 0 0 1 0 0 0
38 .2 47 .1 0 0 0 1 0 0 0 0
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([[float(x) for x in line.split()] for line in LABELLED.strip().splitlines()])
    return rows[:, :-1], rows[:, -1]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9) -> dict:
    """A decision tree: {"feature", "at", "low", "high"} down to {"main"}; splits lower the Gini impurity most."""
    if depth == 0 or len(set(y)) == 1:
        return {"main": bool(y.mean() >= 0.5)}
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < at
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, at)
    if best is None:
        return {"main": bool(y.mean() >= 0.5)}
    low = x[:, best[1]] < best[2]
    return {"feature": best[1], "at": best[2], "low": grow(x[low], y[low], depth - 1), "high": grow(x[~low], y[~low], depth - 1)}


def classify(tree: dict, x: np.ndarray) -> np.ndarray:
    """Whether each row of x is main text."""
    if "main" in tree:
        return np.full(len(x), tree["main"])
    low = x[:, tree["feature"]] < tree["at"]
    out = np.zeros(len(x), bool)
    out[low], out[~low] = classify(tree["low"], x[low]), classify(tree["high"], x[~low])
    return out


def main_text(html: str | None, tree: dict) -> str:
    if not html:
        return ""
    blocks, has_content = page_blocks(html)
    if not blocks:
        return ""
    main = classify(tree, features(blocks, has_content))
    return " ".join(b.text for b, take in zip(blocks, main) if take)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, text and n_chars."""
    tree = grow(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), tree) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    out = rows.mapInArrow(run, "page_id long, url string, text string")
    return out.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
