"""Main text of web pages by text-to-tag ratio (operator 4).

The standard library's streaming parser turns a page into *lines*, one for
each block (paragraph, heading, list item, cell and so on).  A line's
text-to-tag ratio is its length by the number of tags in it; text of scripts, styles and the head makes no lines at all.
The ratios are smoothed by a Gaussian kernel, and a two-means threshold over the
smoothed ratios parts content from the rest.

*Region.*  On every page the content lines select the region: the innermost grouping element
that holds more than half of their text, or the ``article`` or ``main`` element that it lies in.  A region is
kept whole, so that a short paragraph among long ones isn't lost; where nothing smaller than the page
itself is found, it is the content lines and the lines between two of them that are at most ``GAP`` apart.

*Priors.*  Lines in ``article`` and ``main`` weigh ``MAIN_WEIGHT`` times in that choice.  Navigation, footers, sidebars, forms,
adverts, notices and reader comments, told by element, role or class, have ratio 0 and are left out, and so are
menus: ``MENU_LINES`` lines or more in a row that are links as a whole.  Inside of ``article`` and ``main`` paragraphs, headings and lists of links that lead somewhere are text whatever
they are called, and only few names tell an element that groups others apart.  Where all
exclusions together would leave less than ``LEAST_LEFT`` of the page's text, those that hold more than half of it aren't believed, as in a page that
is one large form; navigation, footers and sidebars always are.

Within a line runs of white space become one space; lines are joined by one
space in page order.  Null and empty pages have an empty text.  Rows with null or
repeated page_id are treated one by one; very long pages and deep nesting take time in proportion to their length; extra columns are ignored by ``query``
and kept by ``extract``, but for ``text`` and ``n_chars``, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pages

SIGMA = 1.0
GAP = 3
MAIN_WEIGHT = 2
MENU_LINES = 3
LEAST_LEFT = 0.02
#: Fixed sets of element names, from the HTML standard.
SILENT = {"script", "style", "head", "title", "template", "noscript", "svg", "iframe", "select", "textarea", "button", "canvas", "audio", "video"}
EXCLUDED = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
#: Of these an exclusion is always believed.
NEVER = {"nav", "footer", "aside", "menu"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "output", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
#: Elements that a following element of their kind, or a block for ``p``, closes.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "article", "main", "section", "div", "body", "aside", "nav", "footer", "header", "form", "blockquote"}
#: Elements that a region can be.
GROUPING = {"html", "body", "article", "main", "section", "div", "td", "center", "form", "blockquote"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|footer|sidebar|side|widgets?|comments?|disqus|repl(?:y|ies)|"
    r"notices?|cookies?|consent|gdpr|alert|popup|modal|overlay|newsletter|subscribe|signup|login|social|share|sharing|related|recommended|pagination|pager|toolbar|masthead)(?:$|[\s_-])",
    re.I,
)
#: Inside of an article a class or id tells something else only by these, as a whole or at its start, and only on elements that group others.
_NAMED_INSIDE = re.compile(
    r"(?:^|\s)(?:ads?|advert\w*|adsense|sponsored|promo|comments?|disqus|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|signup|login|share|sharing|sidebar|breadcrumbs?|pagination)(?:[_-][\w-]*)?(?:\s|$)", re.I
)
_CAN_BE_NAMED = {"div", "section", "ul", "ol", "dl", "table", "header", "figure", "details", "center"}
_SPACE = re.compile(r"\s+")


#: Elements that can close others or end the search for what they close.
_BINDING = {"p", *CLOSED_BY, *SCOPE}


@dataclass
class Line:
    text: str
    tags: int
    link_chars: int
    control_chars: int
    element: int


class Lines(HTMLParser):
    """Collects the lines of a page, and its block elements as (name, parent, boilerplate).

    Each step looks at the open elements that matter to it alone, so time doesn't grow with the depth of nesting.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, int, bool]] = [("", -1, False)]
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, the block element that it lies in, silent
        self.places: dict[str, list[int]] = {}  # where in the stack each name is open
        self.binding: list[int] = []  # where in the stack p, list items and scopes are open
        self.blocks: list[int] = [0]  # where in the stack elements that aren't inline are open
        self.mains: list[int] = []  # where in the stack articles and main elements are open
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.link_chars = self.control_chars = 0
        self.leads: dict[int, bool] = {}  # whether the link that is open at a place in the stack leads anywhere

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append(Line(text, max(1, self.tags), self.link_chars, self.control_chars, self.stack[-1][1]))
        self.parts, self.tags, self.link_chars, self.control_chars = [], 0, 0, 0

    def pop_to(self, at: int) -> None:
        for k in range(len(self.stack) - 1, at - 1, -1):
            self.places[self.stack[k][0]].pop()
        for held in (self.binding, self.blocks, self.mains):
            while held and held[-1] >= at:
                held.pop()
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        if tag not in INLINE:
            self.flush()
            for at in reversed(self.binding):
                name = self.stack[at][0]
                if (name == "p" and tag not in VOID) or tag in CLOSED_BY.get(name, ()):
                    self.pop_to(at)
                    break
                if name in SCOPE:
                    break
        self.tags += 1
        if tag in VOID:
            return
        _, element, silent = self.stack[-1]
        found = dict(attrs)
        boiler = tag in EXCLUDED or (found.get("role") or "").lower() in ROLES or "hidden" in found
        called = f"{found.get('class') or ''} {found.get('id') or ''}"
        if self.mains:
            boiler = boiler or (tag in _CAN_BE_NAMED and bool(_NAMED_INSIDE.search(called)))
        else:
            boiler = boiler or (tag not in ("html", "body", *MAIN) and bool(_NAMED.search(called)))
        if tag not in INLINE or boiler:
            if tag in INLINE:
                self.flush()
            name = "main" if found.get("role") == "main" else tag
            self.elements.append((name, element, boiler))
            element = len(self.elements) - 1
        at = len(self.stack)
        if tag in MAIN or found.get("role") == "main":
            self.mains.append(at)
        self.places.setdefault(tag, []).append(at)
        if tag == "a":
            self.leads[at] = "href" in found
        if tag in _BINDING:
            self.binding.append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        self.stack.append((tag, element, silent or tag in SILENT))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "b", "a", "i"):  # those are not closed by their slash
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        where = self.places.get(tag)
        if not where:
            if tag not in INLINE:
                self.flush()
            return
        at = where[-1]
        if tag in INLINE:
            if at < self.blocks[-1]:  # it was opened outside of the block
                return
            if self.stack[at - 1][1] != self.stack[-1][1]:
                self.flush()
        else:
            self.flush()
        self.pop_to(at)

    def handle_data(self, data):
        if not self.stack[-1][2]:
            self.parts.append(data)
            if self.places.get("a"):
                size = len("".join(data.split()))
                self.link_chars += size
                self.control_chars += 0 if self.leads[self.places["a"][-1]] else size

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown keyword: browsers take it for a comment
            return self.parse_bogus_comment(i)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios under a Gaussian kernel of three sigma to each side; beyond the ends the end goes on."""
    reach = int(3 * sigma)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Between the two clusters of the values: half way between their means, found by repeated division."""
    cut = (values.max() + values.min()) / 2
    for _ in range(50):
        low, high = values[values < cut], values[values >= cut]
        if not len(low):
            break
        fresh = (low.mean() + high.mean()) / 2
        if abs(fresh - cut) < 1e-9:
            break
        cut = fresh
    return float(min(cut, values.max()))


def _content(ratios: np.ndarray) -> np.ndarray:
    """Which lines belong to the cluster of high smoothed ratios."""
    values = smoothed(ratios)
    found = (values >= threshold(values)) & (ratios > 0)
    return found if found.any() else ratios == ratios.max()


def _menus(lines: list[Line], inside: np.ndarray) -> np.ndarray:
    """Lines of runs that are links as a whole; ``inside`` of an article only links that lead nowhere, which are controls."""
    linked = [0 < len("".join(x.text.split())) <= (x.control_chars if i else x.link_chars) for x, i in zip(lines, inside.tolist())] + [False]
    out, first = np.zeros(len(lines), bool), 0
    for i, link in enumerate(linked):
        if not link:
            if i - first >= MENU_LINES:
                out[first:i] = True
            first = i + 1
    return out


def _held(parents: list[int], at: list[int], weight: np.ndarray) -> list[float]:
    """The weight that each element holds, with all below it; parents come before their children."""
    total = [0.0] * len(parents)
    for e, w in zip(at, weight.tolist()):
        total[e] += w
    for e in range(len(parents) - 1, 0, -1):
        total[parents[e]] += total[e]
    return total


def _inherited(parents: list[int], own: list[bool]) -> list[bool]:
    """Which elements lie in one of ``own``, or are one."""
    out = list(own)
    for e in range(1, len(parents)):
        out[e] = out[e] or out[parents[e]]
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    names, parents, boiler = ([e[i] for e in parser.elements] for i in range(3))
    at = [x.element for x in lines]
    main = _inherited(parents, [n in MAIN for n in names])
    # The head of a page is boilerplate, the head of an article isn't.
    boiler = [b or (n == "header" and not m) for b, n, m in zip(boiler, names, main)]
    size, ratios = np.array([len(x.text) for x in lines]), np.array([len(x.text) / x.tags for x in lines])
    menu = _menus(lines, np.array(main)[at])
    left = lambda: ~np.array(_inherited(parents, boiler))[at] & ~menu
    usable = left()
    if size[usable].sum() < LEAST_LEFT * size.sum():
        held = _held(parents, at, size)
        boiler = [b and (n in NEVER or 2 * h <= held[0]) for b, n, h in zip(boiler, names, held)]
        usable = left()
    if not usable.any():
        return ""
    ratios = np.where(usable, ratios, 0.0)
    content = _content(ratios) & usable
    weighs = np.where(np.array(main)[at], MAIN_WEIGHT, 1)
    held = _held(parents, at, np.where(content, size * weighs, 0))
    region = 0
    for e in range(1, len(names)):  # children come after their parents: the last is the innermost
        if names[e] in GROUPING and 2 * held[e] > held[0]:
            region = e
    above = region
    while above > 0:
        if names[above] in MAIN:
            region = above
        above = parents[above]
    if names[region] in ("", "html", "body"):
        keep, places = content.copy(), np.flatnonzero(content)
        for a, b in zip(places, places[1:]):
            if b - a <= GAP:
                keep[a:b] |= usable[a:b]
    else:
        keep = np.array(_inherited(parents, [e == region for e in range(len(names))]))[at] & usable
    return " ".join(x.text for x, k in zip(lines, keep) if k)


def extract(table: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text``, the main text of the page, and its length ``n_chars``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(h) for h in batch.to_pylist()], pa.string())

    found = table.withColumn("text", F.arrow_udf(run, "string")(F.col(html).cast("string")))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(pages(spark, sf_dir).select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
