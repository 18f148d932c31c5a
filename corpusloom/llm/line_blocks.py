"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of text. Each line has the length of its text outside links; a line's
block is a window of lines around it, and the sum of their lengths tells prose from lists of links and short notices.
The text surges where the sum first passes a threshold and dives where it falls below it; what stands between is kept,
down to the short lines in it. A page's text is all such stretches in page order; where one container holds lines of two
neighbours, as around a table or list in the middle of an article, the lines between them are kept too.

Elements that announce themselves as something else (menus, headers, footers, sidebars, notices, adverts, forms,
comments) are left out, scripts and their like are no lines at all. Some of this is weak evidence: forms, which may
stand around a whole page, names that only contain a word of these (``menu-item-recipe``), and elements that never end.
There the sums of lengths decide: what holds most of a page's dense text is kept. A class or id that tells of the layout
(``has-sidebar``) announces nothing, nor does anything around the article itself.

Defined cases: a null or empty page, or one without text, has an empty main text; unclosed elements end with what
surrounds them; a page of any length is read once from front to back; rows that repeat are extracted one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import map_rows

WINDOW = 3
"""Lines on each side whose lengths are summed with a line's own."""

SURGE = 80
"""Sum of lengths at which text begins."""

MARKED = 4
"""Weight of an article's text against that of elements that may be something else."""

GAP = 2
"""Lines below the threshold that a stretch of text may hold."""

# Element names and words of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset("article blockquote body div main section td".split())
OPAQUE = frozenset("script style noscript template svg annotation textarea select iframe object canvas audio video head title".split())
ASIDE = frozenset("nav header footer aside menu dialog button label".split())
CONTROLS = frozenset("form fieldset".split())
UNENDED = frozenset("dd dt li option p tbody td tfoot th thead tr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NAME = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|menu|nav\w*|newsletter|notice|popup|promo\w*|"
    r"related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget"
)
PLACES = frozenset(
    "area articles bar block body bottom box button buttons col column consent container desktop footer form global group icons inner item items left "
    "link links list local mobile modal outer overlay page panel post posts primary replies reply respond right row secondary section signup site slot "
    "stories story text thread top unit wrap wrapper".split()
)
"""Words that say where something stands: next to these a name means what it says, next to others (``social-science``) it may not."""

LAYOUT = re.compile(
    r"(?i)^(?:has|no|not|with|without)[_-]|[_-](?:open|opened|closed|enabled|disabled)$|^(?:entry|post|page|article)[_-]header$|^elementor-widget(?:-|$)"
)
"""Classes that tell whether something is there, not that the element is it; headings of articles; parts of page builders."""

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


class Line(NamedTuple):
    """A block's text, the length of what is not in links, whether it stands in an element marked as the article, the
    number of its nearest container, and that of the nearest announced element around it, or -1."""

    text: str
    length: int
    marked: bool
    container: int
    aside: int


@dataclass(slots=True)
class Aside:
    """An element that announces something else: the number of the announced element around it, or -1, and whether what
    announces it is weak evidence."""

    outer: int
    weak: bool


@dataclass(slots=True)
class Article:
    """An article or main element: the number of the announced element around it, or -1, and its text's length."""

    name: str
    aside: int
    length: int = 0


def _evidence(value: str, in_article: bool) -> int:
    """What a class or id tells: 0 nothing, 1 that the element may be something else, 2 that it is. A header in an article
    is its heading."""
    found = 0
    for token in value.lower().split():
        parts = [part for part in re.split("[_-]", token) if part]
        named = [part for part in parts if NAME.fullmatch(part) and not (in_article and part == "header")]
        if named and not LAYOUT.search(token):
            found = max(found, 2 if all(part in PLACES or NAME.fullmatch(part) for part in parts) else 1)
    return found


def _announced(name: str, attributes: str, in_article: bool) -> int:
    """What an element's name and attributes tell, as ``_evidence``; an article's own header is part of it."""
    if name in ASIDE and not (name == "header" and in_article):
        return 2
    found = int(name in CONTROLS)
    if not attributes or name in ("html", "body", "article", "main"):
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES or key == "hidden":
            return 2
        if key in ("class", "id"):
            found = max(found, _evidence(value, in_article))
    return found


def _read_lines(html: str) -> tuple[list[Line], list[Aside], list[Article]]:
    """Lines outside opaque elements, announced elements (outer ones first) and articles."""
    lines: list[Line] = []
    asides: list[Aside] = []
    articles: list[Article] = []
    parts: list[str] = []
    outside = 0
    open_names: list[tuple[str, bool, int]] = []  # name, opaque, number of the announced element or -1
    around, inside, containers = [-1], [-1], [0]
    skipped = links = 0

    def end_line() -> None:
        nonlocal outside
        text = " ".join(unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, outside, inside[-1] >= 0, containers[-1], around[-1]))
            if inside[-1] >= 0 and articles[inside[-1]].aside == around[-1]:
                articles[inside[-1]].length += outside
        parts.clear()
        outside = 0

    def close(count: int) -> None:
        nonlocal skipped, links
        for left in range(count, 0, -1):
            name, opaque, aside = open_names.pop()
            skipped -= opaque
            if aside >= 0:
                around.pop()
                if left > 1 and name not in UNENDED:
                    asides[aside].weak = True
            if name in ("article", "main"):
                inside.pop()
            links -= name == "a"
            if name in CONTAINERS:
                containers.pop()

    at = 0
    while at < len(html):
        token = _TOKEN.search(html, at)
        stop = token.start() if token else len(html)
        if stop > at and not skipped:
            text = html[at:stop]
            parts.append(text)
            if not links:
                outside += len(text.strip())
        if not token:
            break
        at = token.end()
        if token[2] is None:
            continue
        name = token[2].lower()
        if token[1]:
            depth = next((k for k in range(len(open_names) - 1, -1, -1) if open_names[k][0] == name), None)
            if name in BLOCKS and not skipped:
                end_line()
            if depth is not None:
                close(len(open_names) - depth)
            continue
        if name in BLOCKS and not skipped:
            end_line()
        if name in EMPTY or token[3].endswith("/") and name not in BLOCKS:
            continue
        opaque = name in OPAQUE
        if opaque and name not in ("head", "title"):
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            at = end.start() if end else len(html)
        if name == "p" and open_names:  # a paragraph ends the one before it
            depth = next((k for k in range(len(open_names) - 1, -1, -1) if open_names[k][0] == "p"), None)
            if depth is not None and not any(o[0] in BLOCKS for o in open_names[depth + 1 :]):
                close(len(open_names) - depth)
        aside = -1
        evidence = 0 if opaque or skipped else _announced(name, token[3], inside[-1] >= 0)
        if evidence:
            if name not in BLOCKS:
                end_line()
            aside = len(asides)
            asides.append(Aside(around[-1], evidence < 2))
            around.append(aside)
        open_names.append((name, opaque, aside))
        skipped += opaque
        if name in ("article", "main"):
            inside.append(len(articles))
            articles.append(Article(name, around[-1]))
        links += name == "a"
        if name in CONTAINERS:
            containers.append(at)
    if not skipped:
        end_line()
    for name, _, aside in open_names:
        if aside >= 0 and name not in UNENDED:
            asides[aside].weak = True
    return lines, asides, articles


def page_lines(html: str) -> list[Line]:
    """The page's lines in order, without those of announced elements.

    Nothing is announced around the page's ``main``; nor around its longest article, if none with text stands elsewhere and it
    is longer than all that does. Weak evidence is for the density of text to judge: an element with more than half of
    the text in dense lines, an article's counted ``MARKED`` times, is what the page is about.
    """
    lines, asides, articles = _read_lines(html)
    if not asides:
        return lines
    free = [False] * len(asides)
    mains = [a for a in articles if a.name == "main" and a.aside >= 0]
    best = max(mains or articles, key=lambda a: a.length, default=None)
    elsewhere = sum(line.length for line in lines if line.aside < 0)
    if best and (mains or best.length > elsewhere and not any(a.aside < 0 and a.length for a in articles)):
        at = best.aside
        while at >= 0:
            free[at] = True
            at = asides[at].outer

    def left_out(weak_too: bool) -> list[bool]:
        out: list[bool] = []
        for k, aside in enumerate(asides):
            out.append(aside.outer >= 0 and out[aside.outer] or not free[k] and (weak_too or not aside.weak))
        return out

    strong = left_out(False)
    rest = [line for line in lines if line.aside < 0 or not strong[line.aside]]
    lengths = np.array([line.length for line in rest], np.int64)
    dense = window_sums(lengths) >= SURGE
    mass = [0] * len(asides)
    total = 0
    for line, counts in zip(rest, dense.tolist() if dense.any() else [True] * len(rest), strict=True):
        weight = line.length * counts * (MARKED if line.marked else 1)
        total += weight
        if line.aside >= 0:
            mass[line.aside] += weight
    for k in range(len(asides) - 1, -1, -1):
        if asides[k].outer >= 0:
            mass[asides[k].outer] += mass[k]
    for k, aside in enumerate(asides):
        free[k] = free[k] or aside.weak and 2 * mass[k] > total
    out = left_out(True)
    return [line for line in lines if line.aside < 0 or not out[line.aside]]


def window_sums(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per line the sum of lengths in the window around it."""
    return np.convolve(lengths, np.ones(2 * window + 1, np.int64), "full")[window : window + len(lengths)] if len(lengths) else lengths


def text_stretches(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE, gap: int = GAP) -> list[tuple[int, int]]:
    """Ranges of lines from a surge to the dive after it."""
    dense = window_sums(lengths, window) >= surge
    edges = np.flatnonzero(np.diff(np.concatenate([[False], dense, [False]]).view(np.int8)))
    found: list[tuple[int, int]] = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if found and a - found[-1][1] <= gap:
            found[-1] = found[-1][0], b
        else:
            found.append((a, b))
    return found


def main_text(html: str | None) -> str:
    """The page's main text, one block a line.

    A line in an element marked as the article counts ``SURGE`` more, so text surges where the article begins and
    dives where it ends, however short its lines are.
    """
    lines = page_lines(html or "")
    if not lines:
        return ""
    marked = np.array([line.marked for line in lines])
    lengths = np.array([line.length for line in lines], np.int64) + SURGE * marked
    stretches = text_stretches(lengths)
    if not stretches:
        return "\n".join(line.text for line in lines if line.length)
    kept: list[tuple[int, int]] = []
    before: set[int] = set()
    for a, b in stretches:
        # The window reaches past both ends: there an article's edge is the point, or else the last line with text of its own.
        own = marked[a:b] if marked[a:b].any() else lengths[a:b] > 0
        inside = np.flatnonzero(own)
        a, b = a + int(inside[0]), a + int(inside[-1]) + 1
        containers = {line.container for line in lines[a:b] if line.length}
        if before & containers:
            a = kept.pop()[0]
            before |= containers
        else:
            before = containers
        kept.append((a, b))
    return "\n".join(line.text for a, b in kept for line in lines[a:b])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row its id and URL, its main ``text`` and the text's length in code points."""

    def extract(page_id, url, html) -> Iterator[tuple]:
        text = main_text(html)
        yield page_id, url, text, len(text)

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col)]
    rows = pages.select(id_col, url_col, F.col(html_col))
    return map_rows(rows, f"{', '.join(kinds)}, text string, n_chars bigint", extract)
