"""Expressions over raw HTML that need no document tree."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.functions.binding import each, let
from corpusloom.functions.text import is_blank, trim_ws

# Length of the body prefix the sniffing rules look at. This is their definition, not a saving.
SNIFF_CHARS = 4096
THIN_CHARS = 600

# Marks of an HTML document, looked for in lower case.
HTML_MARKS = ("<!doctype html", "<html", "<head", "<body")

# Challenge signatures and labels; the first one that occurs gives the label.
CHALLENGE_SIGNATURES = (
    ("sgcaptcha", "SiteGround CAPTCHA (SGCaptcha)"),
    ("/.well-known/sgcaptcha", "SiteGround CAPTCHA redirect"),
    ("cf-challenge", "Cloudflare challenge"),
    ("Just a moment", "Cloudflare JS challenge"),
    ("attention required", "Cloudflare Attention Required"),
    ("enable javascript", "JavaScript-required gate"),
    ("captcha", "Generic CAPTCHA"),
    ("hCaptcha", "hCaptcha challenge"),
    ("g-recaptcha", "Google reCAPTCHA"),
    ("Checking your browser", "Browser verification gate"),
    ("DDoS protection by", "DDoS protection interstitial"),
)

_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_RAW_TEXT = r"(?is)<(script|style|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\z)"
# Quoted attribute values may hold ">"; a quote that is never closed runs to the end of the page.
_ANCHOR = r"""(?i)<a(?=[\s/])(?:[^'">]++|"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))*+(?:>|\z)"""
_LATIN1 = r"[\x{A0}-\x{FF}]"
# Attributes in order, each with its value, up to the first href: text inside another value is not one.
_HREF = (
    r"""(?is)^<a(?:[\s/]++|"[^"]*+"?|'[^']*+'?|(?!href\s*=)[^\s=/>"']++(?:\s*+=\s*+(?:"[^"]*+"?|'[^']*+'?|[^\s"'>]++))?+|=)*+"""
    r"""href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
)


def looks_like_html(body: Column) -> Column:
    head = F.lower(F.substring(body, 1, SNIFF_CHARS))
    found = F.lit(False)
    for mark in HTML_MARKS:
        found = found | F.contains(head, F.lit(mark))
    return F.coalesce(found, F.lit(False))


def detect_challenge(body: Column) -> Column:
    """Label of the first challenge signature in the body prefix; null for a normal page."""

    def first_label(head: Column) -> Column:
        return F.coalesce(
            *[F.when(F.contains(head, F.lit(pattern.lower())), F.lit(label)) for pattern, label in CHALLENGE_SIGNATURES]
        )

    return let(F.lower(F.substring(body, 1, SNIFF_CHARS)), first_label)


def is_challenge(body: Column) -> Column:
    return detect_challenge(body).isNotNull()


def is_too_thin(body: Column, threshold: int = THIN_CHARS) -> Column:
    return F.coalesce(F.length(body) < threshold, F.lit(True)) | is_blank(body)


def accepts_response(status: Column, content_type: Column, body: Column) -> Column:
    """Whether a response can become a page: by status, declared type and body prefix."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    declared = F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("xml"))
    success = F.coalesce(status.between(200, 299), F.lit(False))
    return ~is_blank(body) & ((success & declared) | looks_like_html(body))


def _entity_table() -> str:
    """SQL text of a map from entity name to characters, made from Python's HTML5 table."""
    names = {name[:-1]: value for name, value in html5.items() if name.endswith(";")}
    quoted = json.dumps(names).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{quoted}', 'map<string,string>')"


def _character(code: str) -> str:
    """SQL text of the character with a code point; null where there is none."""
    char = "decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32')"
    known = "n BETWEEN 1 AND 1114111 AND n NOT BETWEEN 55296 AND 57343"
    return f"element_at(transform(array(CAST({code} AS BIGINT)), n -> if({known}, {char}, NULL)), 1)"


def _resolved(pattern: str, end: str) -> str:
    """SQL text of ``part`` with the reference ``pattern`` at its start resolved; null without one."""
    return rf"""element_at(transform(array(regexp_extract(part, '{pattern}', 1)), ref -> concat(
        CASE WHEN ref = '' THEN NULL
            WHEN ref rlike '^#[0-9]' THEN {_character("substring(ref, 2)")}
            WHEN startswith(ref, '#') THEN {_character("conv(substring(ref, 3), 16, 10)")}
            ELSE try_element_at({_entity_table()}, ref) END,
        regexp_replace(substring(part, length(ref) + 1), '^{end}', ''))), 1)"""


_NUMBER = "#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}"
_CLOSED = f"^({_NUMBER}|[A-Za-z][A-Za-z0-9]{{1,31}});"
# Names that also count without a semicolon, longest first.
_OLD_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _after_ampersand(open_pattern: str | None) -> str:
    """Function of the text after an ampersand (and its place) that resolves the reference it starts with."""
    tries = [_resolved(_CLOSED, ";")] + ([_resolved(open_pattern, ";?")] if open_pattern else [])
    return f"(part, i) -> if(i = 0, part, coalesce({', '.join(tries)}, concat('&', part)))"


# Only closed references; as a browser reads text; as a browser reads attribute values.
_REFERENCES = {
    "closed": _after_ampersand(None),
    "text": _after_ampersand(f"^({_NUMBER}|{_OLD_NAMES})"),
    "attribute": _after_ampersand(f"^({_NUMBER}|(?:{_OLD_NAMES})(?![=A-Za-z0-9]))"),
}


def decode_entities(text: Column, kind: str = "closed") -> Column:
    """Resolve named (``&name;``) and numeric character references.

    ``kind`` ``text`` and ``attribute`` follow browsers, which do without the semicolon after some names.
    """

    def resolved(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("&")), F.array_join(each(F.split(t, "&"), _REFERENCES[kind]), "")).otherwise(t)

    return let(text, resolved)


def _title_markup(body: Column) -> Column:
    element = F.regexp_substr(body, F.lit(r"(?is)<title[^>]*>.*?</title>"))
    return F.regexp_replace(element, r"(?i)^<title[^>]*>|</title>\z", "")


def html_title_regex(body: Column) -> Column:
    """Decoded text of the first ``title`` element as written; null when there is none."""
    return decode_entities(trim_ws(_title_markup(body)))


def html_title(body: Column, url: Column) -> Column:
    """Document title with white space collapsed, or words of the path when it is blank."""
    markup = _title_markup(F.regexp_replace(body, _COMMENT, ""))
    title = trim_ws(F.regexp_replace(decode_entities(markup, "text"), r"[ \t\n\f\r]+", " "))
    return let(title, lambda t: F.when(is_blank(t), U.fallback_title(url)).otherwise(t))


def sanitize_html(body: Column) -> Column:
    """Drop script and style elements; blank becomes empty."""
    plain = F.regexp_replace(body, r"(?i)<script[\s\S]*?</script>", "")
    plain = F.regexp_replace(plain, r"(?i)<style[\s\S]*?</style>", "")
    return F.when(is_blank(body), F.lit("")).otherwise(plain)


def html_encode(text: Column) -> Column:
    """Escape markup characters, and Latin-1 characters from 160 on as numeric references."""
    out = text
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))

    def piece(run: Column) -> Column:
        number = F.conv(F.hex(F.encode(run, "UTF-16BE")), 16, 10)
        return F.when(run.rlike(rf"\A{_LATIN1}"), F.concat(F.lit("&#"), number, F.lit(";"))).otherwise(run)

    def numbered(t: Column) -> Column:
        runs = F.regexp_extract_all(t, F.lit(rf"{_LATIN1}|[^\x{{A0}}-\x{{FF}}]+"), F.lit(0))
        return F.when(t.rlike(_LATIN1), F.array_join(F.transform(runs, piece), "")).otherwise(t)

    return let(out, numbered)


def html_encode_paragraph(text: Column) -> Column:
    return F.concat(F.lit("<p>"), html_encode(text), F.lit("</p>"))


def wrap_article(html: Column) -> Column:
    return F.concat(F.lit("<article>"), html, F.lit("</article>"))


def hrefs(body: Column) -> Column:
    """Non-blank ``href`` values of all anchors in document order, outside comments and raw-text elements."""
    visible = F.regexp_replace(F.regexp_replace(body, _COMMENT, ""), _RAW_TEXT, "")
    tags = F.regexp_extract_all(visible, F.lit(_ANCHOR), F.lit(0))
    values = F.transform(
        F.filter(tags, lambda tag: tag.rlike(_HREF)),
        lambda tag: decode_entities(
            F.concat(F.regexp_extract(tag, _HREF, 1), F.regexp_extract(tag, _HREF, 2), F.regexp_extract(tag, _HREF, 3)),
            "attribute",
        ),
    )
    return F.array_distinct(F.filter(values, lambda h: ~is_blank(h)))


def page_links(body: Column, page_url: Column, root_url: Column, same_host_only: Column) -> Column:
    """Distinct canonical http links of a page in document order, all computed inside its row."""
    urls = U.canonicalize_all(U.resolve_all(page_url, hrefs(body)))
    kept = F.filter(urls, lambda u: u.isNotNull() & U.is_http(u) & U.same_host(u, root_url, same_host_only))
    return F.array_distinct(kept)
