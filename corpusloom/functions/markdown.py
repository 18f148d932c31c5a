"""Main content of one HTML page as GitHub-flavoured markdown.

A single pass over the tags with a stack of open elements: every element's inner markdown is built
bottom-up, so no tree is kept and nesting depth is not limited by recursion. The markdown of the
first ``main``, ``article``, ``role=main``, content-class and body element is noted when it closes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable

# Attribute text up to the end of a tag; a quote that is never closed runs to the end of the page.
_INSIDE = r"""(?:[^'">]++|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+"""
_TOKEN = re.compile(
    rf"[^<]+|<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|textarea|title)\b{_INSIDE}(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_INSIDE})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|<",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_OUTER_TAGS = re.compile(r"(?is)^<[^>]*>|</textarea\s*>$")
_ESCAPE = re.compile(r"([*_])")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILERPLATE = frozenset("script style noscript nav footer header aside".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre section summary table ul".split()
)
# Elements an opening tag closes when they are still open, and where the search for them stops.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
SCOPE = frozenset("table td th button caption html".split())
CONTENT_CLASSES = frozenset(("content", "entry-content", "post-content"))
CONTAINERS = ("main", "article", "role", "class", "body")
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Elements in which white space between tags means nothing.
NO_TEXT = frozenset("ul ol table thead tbody tfoot tr".split())


class _Open:
    """An element whose end has not been seen yet."""

    __slots__ = ("tag", "attrs", "out", "roles", "count", "cells")

    def __init__(self, tag: str, attrs: dict[str, str], roles: list[str]):
        self.tag, self.attrs, self.roles = tag, attrs, roles
        self.out: list[str] = []
        self.count = 0
        self.cells: list = []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTR.findall(text):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def _indent(text: str, width: int) -> str:
    return text.replace("\n", "\n" + " " * width)


def _wrap(inner: str, mark: str) -> str:
    core = inner.strip()
    if not core:
        return inner
    lead = inner[: len(inner) - len(inner.lstrip())]
    tail = inner[len(inner.rstrip()) :]
    return f"{lead}{mark}{core}{mark}{tail}"


def _table(rows: list[list[str]]) -> str:
    width = max(len(r) for r in rows)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    lines.insert(1, "|" + " --- |" * width)
    return "\n".join(lines)


def _roles(tag: str, attrs: dict[str, str]) -> list[str]:
    """Container rules an opening tag satisfies."""
    roles = [tag] if tag in ("main", "article") else []
    if attrs:
        if attrs.get("role") == "main":
            roles.append("role")
        if CONTENT_CLASSES.intersection(attrs.get("class", "").split()):
            roles.append("class")
    return roles


def _nearest(stack: list[_Open], tags: tuple[str, ...]) -> _Open | None:
    return next((o for o in reversed(stack) if o.tag in tags), None)


def _render(el: _Open, inner: str, stack: list[_Open], depth: Counter[str]) -> str:
    """Markdown of a closed element as its parent sees it."""
    tag = el.tag
    if tag in BOILERPLATE:
        return ""
    if depth["pre"]:
        return inner
    if tag in ("strong", "b"):
        return inner if depth["strong"] or depth["b"] else _wrap(inner, "**")
    if tag in ("em", "i"):
        return inner if depth["em"] or depth["i"] else _wrap(inner, "*")
    if tag in ("s", "strike", "del"):
        return _wrap(inner, "~~")
    if tag == "code":
        return _wrap(inner, "`")
    core = inner.strip()
    if tag == "a":
        href = el.attrs.get("href", "").strip()
        return f"[{core}]({href})" if href and core else inner
    if tag in ("td", "th") and (row := _nearest(stack, ("tr",))):
        row.cells.append(core.replace("\n", " ").replace("|", "\\|"))
        return ""
    if tag == "tr" and (table := _nearest(stack, ("table",))):
        if el.cells:
            table.cells.append(el.cells)
        return inner if core else ""
    if tag == "table":
        return f"\n\n{core}\n\n{_table(el.cells) if el.cells else ''}\n\n"
    if tag not in BLOCKS:
        return inner
    if not core:
        return "\n\n"
    if tag == "pre":
        fence = inner.strip("\n")
        return f"\n\n```\n{fence}\n```\n\n"
    if tag == "li":
        owner = _nearest(stack, ("ul", "ol", "menu"))
        mark = "- "
        if owner is not None and owner.tag == "ol":
            owner.count += 1
            mark = f"{owner.count}. "
        return f"{mark}{_indent(core, len(mark))}\n"
    if tag in ("ul", "ol", "menu"):
        gap = "\n" if depth["li"] else "\n\n"
        return gap + inner.strip("\n") + gap
    if tag in HEADINGS:
        return f"\n\n{'#' * int(tag[1])} {_SPACE.sub(' ', core)}\n\n"
    if tag == "blockquote":
        return "\n\n> " + re.sub(r"\n{3,}", "\n\n", core).replace("\n", "\n> ") + "\n\n"
    return f"\n\n{core}\n\n"


def main_markdown(page: str) -> str | None:
    """Markdown of the main content, before whitespace clean-up; None when the page has no container."""
    stack = [_Open("body", {}, ["body"])]
    depth: Counter[str] = Counter()
    formats: list[_Open] = []
    results: dict[str, str] = {}
    taken: set[str] = set()
    has_frames = False

    def push(el: _Open) -> None:
        stack.append(el)
        depth[el.tag] += 1

    def close_through(index: int) -> None:
        while len(stack) > index:
            el = stack.pop()
            depth[el.tag] -= 1
            inner = "".join(el.out)
            for role in el.roles:
                results[role] = inner
            if stack:
                stack[-1].out.append(_render(el, inner, stack, depth))

    def close_within(tags: Iterable[str], stops: Iterable[str]) -> None:
        """Close the outermost open element of ``tags`` that no element of ``stops`` shields."""
        found = 0
        if not any(depth[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                found = i
            elif stack[i].tag in stops:
                break
        if found:
            close_through(found)

    def reopen() -> None:
        """Formatting left open when its block ended carries on in the next one."""
        for i, el in enumerate(formats):
            if el not in stack:
                formats[i] = _Open(el.tag, el.attrs, [])
                push(formats[i])

    def text(raw: str) -> None:
        value = html.unescape(raw) if "&" in raw else raw
        if not depth["pre"]:
            value = _SPACE.sub(" ", value)
            if value == " " and stack[-1].tag in NO_TEXT:
                return
            if not depth["code"]:
                value = _ESCAPE.sub(r"\\\1", value)
            if value[0] == " " and stack[-1].out and stack[-1].out[-1].endswith("\n"):
                value = value[1:]
        if value:
            if formats and not value.isspace():
                reopen()
            stack[-1].out.append(value)

    for m in _TOKEN.finditer(page):
        tag = m.group("tag")
        if tag is None:
            token = m.group()
            if token[0] != "<" or token == "<":
                text(token)
            elif (m.group("raw") or "").lower() == "textarea":
                text(_OUTER_TAGS.sub("", token) or " ")
            continue
        tag = tag.lower()
        if m.group("close"):
            if tag in FORMATTING:
                last = next((f for f in reversed(formats) if f.tag == tag), None)
                if last is not None:
                    formats.remove(last)
            if tag == "p" and not depth["p"]:
                stack[-1].out.append("\n\n")
            elif depth[tag]:
                shield = () if tag in SCOPE else ("table", "td", "th")
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close_through(i)
                        break
                    if stack[i].tag in shield:
                        break
            continue
        if tag in ("html", "head", "body", "frameset"):
            has_frames = has_frames or tag == "frameset"
            continue
        if tag == "br":
            stack[-1].out.append("\n")
            continue
        if tag in BLOCKS or tag == "hr":
            close_within(("p",), SCOPE)
        if tag == "hr":
            stack[-1].out.append("\n\n* * *\n\n")
            continue
        attrs = _attributes(m.group("attrs")) if len(m.group("attrs")) > 2 else {}
        if tag in VOID:
            if tag == "img" and attrs.get("src"):
                stack[-1].out.append(f"![{attrs.get('alt', '')}]({attrs['src']})")
            continue
        if tag in IMPLIED_END:
            close_within(*IMPLIED_END[tag])
        roles = [role for role in _roles(tag, attrs) if role not in taken]
        taken.update(roles)
        if formats and (tag in FORMATTING or tag not in BLOCKS):
            reopen()
        el = _Open(tag, attrs, roles)
        push(el)
        if tag in FORMATTING:
            alike = [f for f in formats if f.tag == tag and f.attrs == attrs]
            if len(alike) >= 3:
                formats.remove(alike[0])
            formats.append(el)
    close_through(0)
    if has_frames:
        return None
    return next(results[role] for role in CONTAINERS if role in results)
