"""Main text of web pages: text-to-tag ratios of lines, smoothed and clustered, over a stream of parser events.

The parser (standard library, fed in slices) gives events; block elements end lines. Each line carries the length of
its text outside links and the number of tags seen since the line before. The logarithms of the ratios are smoothed by a
Gaussian over neighbouring lines, and a threshold found by two-means clustering splits them into content and the rest.
A line's evidence is its distance from the threshold: content lines count for the elements around them, lines of links
below it against them, and other short lines neither way. The element with the most evidence is the region, the
outermost of equals; all its lines are returned but those that are nothing but links, which are menus in it unless they
are headings or paragraphs.

Structure is a feature beside that: what markup says is a menu, header, footer, sidebar, form or hidden is left out, a
telling class or id leaves an element out unless it holds most of the content, a region within an article or main
widens to it and keeps its links, and an article or main with half the evidence is the region. The first heading is brought in where the
element around it and the region keeps half of the evidence.

Defined results: null or empty html gives an empty text; a page without markup is its text; elements left open end
with the page; a page whose lines all look alike is all content, one of links alone too. Rows repeated or with equal
keys are pages of their own; a null key or url stays null; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
HIDDEN = frozenset("script style noscript template head title svg math canvas iframe object audio video map datalist".split())
OUTSIDE = frozenset("nav footer aside form menu dialog button select textarea fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Start tags that leave an open head open.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Class tokens and ids that mark what isn't the article: such a word, alone or with words of place before and of boxes
#: after it. Other compounds say something about an element that is the article (has-sidebar, category-social).
PLACE = r"(?:site|main|global|top|bottom|left|right|primary|secondary|mobile|desktop|header|footer|article|side|social|google|cookies?|email)"
NAME = r"(?:ads?|advert\w*|adsbygoogle|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|aside|footer\w*|masthead|cookies?|consent|gdpr|notices?|alert|modal|popup|overlay|newsletter|subscribe|signup|login|share\w*|social\w*|related|recommend\w*|comments?|commentlist|disqus\w*|replies|respond|widget\w*|toolbar|pager|pagination|skip\w*)"
BOX = r"(?:left|right|top|bottom|main|primary|secondary|area|bar|box|buttons?|column|container|content|default|fixed|form|group|header|icons?|info|inner|items?|law|links?|list|message|panel|policy|posts?|articles?|section|slot|stories|tabs|text|thread|title|to|toggle|unit|wrap|wrapper|\d+)"
NAMES = re.compile(rf"(?:{PLACE}[_-]+)*{NAME}(?:[_-]+(?:{NAME}|{BOX}))*", re.I)
REMARKS = re.compile(r"(?:.*[_-])?(?:comments?|commentlist|disqus\w*|replies|respond|cookies?|consent|gdpr)(?:[_-].*)?", re.I)
#: A start tag of these ends an open paragraph or item, as browsers do.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: Elements that can be the main region, and those that are it whole.
REGIONS = frozenset("html body main article section div center table tbody tr td".split())
WHOLE = frozenset("main article".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Why an element is outside: by its name, by a name of comments or cookie notices, by its tag or role.
OPEN, NAMED, REMARKED, SHUT = range(4)
SLICE = 1 << 16
SIGMA = 1.0


class Events(HTMLParser):
    """Lines of a page: text, characters outside links, tags before, and the elements around."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # name, number
        self.shut: list[int] = []  # of each numbered element: OPEN, or why it is outside the article
        self.hide: list[int] = []
        self.parents: list[int] = []  # of each numbered element
        self.names: list[str] = []
        self.lines: list[tuple[str, int, int, int]] = []
        self.words: list[str] = []
        self.linked = self.tags = self.links = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append((text, max(0, len(text) - self.linked), self.tags, self.open[-1][1] if self.open else -1))
            self.tags = 0
        self.words, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in HEAD:
            self._end_head()
        if tag in CLOSES_P:
            self._close_to({"p"}, ("table", "td", "th", "button", "div", "article", "section", "body"))
        if tag in SAME:
            names, bound = SAME[tag]
            self._close_to(set(names.split()), bound)
        if tag not in INLINE and tag not in HIDDEN:
            self.end_line()
        if tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        self.parents.append(self.open[-1][1] if self.open else -1)
        self.names.append(tag)
        self.open.append((tag, len(self.names) - 1))
        why = OPEN
        if tag in HIDDEN:
            self.hide.append(len(self.open))
        elif tag not in ("html", "body", "main", "article"):
            why = SHUT if tag in OUTSIDE or (tag == "header" and not any(n == "article" for n, _ in self.open)) else self._named(attrs)
        self.shut.append(why)
        self.links += tag == "a"

    def _named(self, attrs) -> int:
        a = dict(attrs)
        if (a.get("role") or "").lower() in ROLES or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true":
            return SHUT
        words = [x for k in ("class", "id") for x in (a.get(k) or "").split() if NAMES.fullmatch(x)]
        return max((REMARKED if REMARKS.fullmatch(x) else NAMED for x in words), default=OPEN)

    def _end_head(self) -> None:
        """What can't stand in a head ends it, as in browsers."""
        if self.open and self.open[-1][0] == "head":
            self._cut(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE and tag not in HIDDEN:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self._cut(i)
                return
            if tag in INLINE and self.open[i][0] not in INLINE:
                return

    def _cut(self, depth: int) -> None:
        for name, _ in self.open[depth:]:
            self.links -= name == "a"
        del self.open[depth:]
        while self.hide and self.hide[-1] > depth:
            self.hide.pop()

    def _close_to(self, names: set[str], bound: tuple[str, ...]) -> None:
        """Close the nearest open element of names, if none of bound is nearer."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                self.end_line()
                self._cut(i)
                return
            if self.open[i][0] in bound:
                return

    def handle_data(self, data):
        if self.hide and data.strip():
            self._end_head()
        if self.hide:
            return
        self.words.append(data)
        if self.links:
            self.linked += len(data.strip())

    def rest(self) -> None:
        """The page ends: what the parser still holds is text, and open elements end."""
        self.close()
        self.end_line()


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian over neighbours, the ends weighted by what is there."""
    r = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, k)[r : r + len(x)] / np.convolve(np.ones(len(x)), k)[r : r + len(x)]


def threshold(x: np.ndarray) -> float:
    """Border of the two-means clusters of the smoothed ratios."""
    if x.max() <= 1.5 * x.min():
        return float(x.min())
    a, b = float(x.min()), float(x.max())
    for _ in range(50):
        cut = (a + b) / 2
        c, d = float(x[x < cut].mean()), float(x[x >= cut].mean())
        if (c, d) == (a, b):
            break
        a, b = c, d
    return (a + b) / 2


def extract(html: str | None) -> str:
    """Main text of a page, blocks joined by line feeds."""
    if not html:
        return ""
    p = Events()
    for i in range(0, len(html), SLICE):
        p.feed(html[i : i + SLICE])
    p.rest()
    if not p.lines:
        return ""
    at = [e for _, _, _, e in p.lines]
    shut = outside(p, [w == SHUT for w in p.shut])
    if any(w in (NAMED, REMARKED) for w in p.shut):
        # a name can't shut what holds most of the content (of articles, where there are any); comments and notices can
        # be long, so theirs shut all but what holds every character; and names together can't shut the whole page
        chars, mass = content(p, shut[at])
        own = chars * outside(p, [n in WHOLE for n in p.names])[at]
        mass = own if own.any() else mass
        held, every = below(p, mass), below(p, chars)
        named = outside(p, [w == SHUT or (w == NAMED and held[e] <= held[-1] / 2) or (w == REMARKED and every[e] < every[-1]) for e, w in enumerate(p.shut)])
        shut = shut if named[at].all() else named
    outs = shut[at]
    ratio, cut = ratios(p, outs)
    links = np.array([n == 0 for _, n, _, _ in p.lines])
    region = chosen(p, outs, ratio - cut)
    within, whole = inside(p, region), region >= 0 and p.names[region] in WHOLE
    away = outs | (links & np.array([not whole and not (e >= 0 and p.names[e] in TEXTUAL) for e in at]))
    if not (within[at] & ~away & ~links).any():  # nothing but links
        away = outs
    return "\n".join(line[0] for line, e, out in zip(p.lines, at, away, strict=True) if within[e] and not out)


def ratios(p: Events, outs: np.ndarray) -> tuple[np.ndarray, float]:
    """Smoothed logarithms of the lines' text-to-tag ratios, 0 where a line is outside, and the border of content."""
    chars = np.array([0.0 if out else float(n) for (_, n, _, _), out in zip(p.lines, outs, strict=True)])
    ratio = smooth(np.log1p(chars / np.array([max(1, t) for _, _, t, _ in p.lines])), SIGMA)
    return ratio, threshold(ratio)


def chosen(p: Events, outs: np.ndarray, over: np.ndarray) -> int:
    """The element that most evidence speaks for; over: of each line, how far its ratio is over the threshold."""
    linked = np.array([1 - n / len(text) for text, n, _, _ in p.lines])
    held = below(p, np.where(outs, 0.0, np.where(over >= 0, over, over * linked)))
    region = -1
    for e, name in enumerate(p.names):  # in page order: of equals the outermost
        if name in REGIONS and held[e] > held[region] + 1e-9:
            region = e
    whole = [e for e, name in enumerate(p.names) if name in WHOLE and held[e] >= max(held[region] / 2, 1e-9)]
    around = lines_up(p, region)
    if any(p.names[e] in WHOLE for e in around):
        region = next(e for e in around if p.names[e] in WHOLE)
    elif whole:
        region = max(whole, key=lambda e: (held[e], -e))
    heads = [e for (_, _, _, e), out in zip(p.lines, outs, strict=True) if not out and e >= 0 and p.names[e] == "h1"]
    if heads and region >= 0 and not any(region in lines_up(p, e) for e in heads):
        both = next((e for e in lines_up(p, region) if e in lines_up(p, heads[0])), -1)
        if held[both] >= held[region] / 2:
            region = both
    return region


def lines_up(p: Events, e: int) -> list[int]:
    """The element and those around it, from inside out."""
    out = []
    while e >= 0:
        out.append(e)
        e = p.parents[e]
    return out


def content(p: Events, outs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line, its characters outside links, and those if it is a content line; 0 where it is outside."""
    chars = np.array([0.0 if out else float(n) for (_, n, _, _), out in zip(p.lines, outs, strict=True)])
    ratio, cut = ratios(p, outs)
    mass = np.where(ratio >= cut, chars, 0.0)
    if not mass.sum():
        mass = chars
    if not mass.sum():  # nothing but links
        mass = np.array([float(not out) for out in outs])
    return chars, mass


def below(p: Events, mass: np.ndarray) -> np.ndarray:
    """Sums of the lines' mass below each element and, last, the page itself."""
    held = np.zeros(len(p.names) + 1)
    for m, line in zip(mass, p.lines, strict=True):
        held[line[3]] += m
    for e in range(len(p.names) - 1, -1, -1):
        held[p.parents[e]] += held[e]
    return held


def outside(p: Events, shut: list[bool]) -> np.ndarray:
    """Of each element and, last, the page itself, whether it or one around it is shut."""
    found = np.array([*shut, False])
    for e in range(len(p.names)):
        found[e] |= found[p.parents[e]]  # the page's own, last, where there is none around
    return found


def inside(p: Events, region: int) -> np.ndarray:
    """Of each element and, last, the page itself, whether region holds it; -1 is the page."""
    found = np.zeros(len(p.names) + 1, bool)
    found[region] = True
    for e in range(len(p.names)):
        found[e] |= found[p.parents[e]] if p.parents[e] >= 0 else region == -1
    return found


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars of each page."""

    def run(batches):
        for b in batches:
            texts = [extract(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"key {kinds['key']}, url {kinds['url']}, text string, n_chars long").withColumnRenamed("key", key)


def op5_html_main_text(spark, sf_dir):
    """Contract query over all pages."""
    configure(spark)
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
