"""URL expressions: canonical form, resolution, names.

Every function maps columns to columns. The canonical form is computed over *arrays* of URLs, stage
by stage, so all links of a page are normalised inside its row without a shuffle; the scalar
function is the one-element case.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.binding import apply, each, let
from corpusloom.functions.text import ordinal_fold_sql, trim_ws, trim_ws_sql

# scheme, authority, path, query
_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/\\?#]*)([^?#]*)(\?[^#]*)?"
_HAS_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_PATH_OK = r"!#$%&'()*+,\-./0-9:;=?@A-Z\[\]_a-z~"
_BAD_PERCENT = r"%(?![0-9A-Fa-f]{2})"

# How an href becomes absolute, by its first characters.
_RESOLVED = rf"""x -> CASE
    WHEN startswith(x.h, '#') OR x.h rlike r'(?i)^(mailto|tel):' THEN NULL
    WHEN x.h rlike r'{_HAS_SCHEME}' THEN x.h
    WHEN x.h rlike r'^[/\\]{{2}}' THEN concat(x.at.scheme, '//', substring(x.h, 3))
    WHEN x.h rlike r'^[/\\]' THEN concat(x.at.prefix, x.h)
    WHEN startswith(x.h, '?') THEN concat(x.at.page, x.h)
    ELSE concat(x.at.folder, x.h) END"""

# Tracking parameters left out of canonical URLs.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ("fbclid", "gclid", "msclkid")


def is_tracking_param(key: Column) -> Column:
    folded = F.lower(key)
    return folded.startswith(TRACKING_PREFIX) | folded.isin(*TRACKING_KEYS)


def _encode(x: str) -> str:
    """Percent-encode everything but unreserved characters."""
    return f"replace(replace(replace(url_encode({x}), '+', '%20'), '*', '%2A'), '%7E', '~')"


def _decode(x: str) -> str:
    """Percent-decode, keeping ``+``, malformed escapes and escapes that are not UTF-8 as they are."""
    decoded = f"try_url_decode(replace(regexp_replace({x}, r'{_BAD_PERCENT}', '%25'), '+', '%2B'))"
    valid = f"element_at(transform(array({decoded}), d -> if(contains(d, '\ufffd'), NULL, d)), 1)"
    return f"if(contains({x}, '%'), coalesce({valid}, {x}), {x})"


# One key=value pair, decoded.
_PAIR = f"""(p, i) -> named_struct(
    'key', {_decode("substring_index(p, '=', 1)")},
    'value', if(contains(p, '='), {_decode("regexp_replace(p, '^[^=]*=', '')")}, ''),
    'i', i)"""
_TRACKED = f"""startswith(lower(kv.key), '{TRACKING_PREFIX}') OR lower(kv.key) IN ({", ".join(f"'{k}'" for k in TRACKING_KEYS)})"""


def _query(q: str) -> str:
    """Without tracking parameters, sorted by key (ignoring case) and value, encoded again."""
    pairs = f"filter(transform(filter(split({q}, '&'), p -> p != ''), {_PAIR}), kv -> NOT ({_TRACKED}))"
    keyed = f"transform({pairs}, kv -> named_struct('fold', {ordinal_fold_sql('kv.key')}, 'value', kv.value, 'i', kv.i, 'key', kv.key))"
    return f"array_join(transform(array_sort({keyed}), kv -> concat({_encode('kv.key')}, '=', {_encode('kv.value')})), '&')"


def _without_dots(p: str) -> str:
    """``.`` and ``..`` segments removed."""
    return f"""concat('/', array_join(aggregate(slice(split({p}, '/'), 2, length({p})), CAST(array() AS ARRAY<STRING>),
        (acc, s) -> CASE WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) WHEN s = '.' THEN acc
            ELSE concat(acc, array(s)) END), '/'))"""


def _escaped(p: str) -> str:
    """Characters that may not stand in a path percent-encoded."""
    return f"""array_join(transform(regexp_extract_all({p}, r"[{_PATH_OK}]+|[^{_PATH_OK}]+", 0),
        r -> if(r rlike r"^[{_PATH_OK}]", regexp_replace(r, r'{_BAD_PERCENT}', '%25'), replace(url_encode(r), '+', '%20'))), '')"""


# The stages of the canonical form, each a function of what the one before yields.
_STAGES = (
    f"u -> {trim_ws_sql('u')}",
    rf"""u -> named_struct(
        'scheme', lower(regexp_extract(u, r'{_URL}', 1)),
        'authority', regexp_extract(u, r'{_URL}', 2),
        'path', translate(regexp_extract(u, r'{_URL}', 3), r'\', '/'),
        'query', regexp_replace(regexp_extract(u, r'{_URL}', 4), r'^\?+', ''))""",
    rf"""x -> named_struct(
        'scheme', x.scheme,
        'user', regexp_extract(x.authority, '^(.*@)?', 0),
        'host', regexp_replace(lower(regexp_replace(x.authority, '^.*@', '')),
            CASE x.scheme WHEN 'http' THEN ':(80)?$' WHEN 'https' THEN ':(443)?$' ELSE '$' END, ''),
        'path', regexp_replace(if(x.path rlike r'(^|/)\.{{1,2}}(/|$)', {_without_dots("x.path")}, x.path), '/+$', ''),
        'query', if(x.query = '', '', {_query("x.query")}))""",
    rf"""x -> if(x.scheme = '' OR x.host = '', NULL, concat(x.scheme, '://', x.user, x.host,
        CASE WHEN x.path = '' THEN '/' WHEN x.path rlike r"[^{_PATH_OK}]|{_BAD_PERCENT}" THEN {_escaped("x.path")} ELSE x.path END,
        if(x.query = '', '', concat('?', x.query))))""",
)


def normalize_query(query: Column) -> Column:
    """Drop tracking parameters, sort by key (ignoring case) then value, re-encode; no leading ``?``."""
    return apply(F.regexp_replace(query, r"^\?+", ""), f"q -> {_query('q')}")


def canonicalize_all(urls: Column) -> Column:
    """Canonical form of every URL of an array; null where an entry is not a hierarchical absolute URL."""
    for stage in _STAGES:
        urls = each(urls, stage)
    return urls


def canonicalize(url: Column) -> Column:
    """Canonical absolute URL: the identity of a page."""
    return F.element_at(canonicalize_all(F.array(url)), 1)


def url_key(url: Column) -> Column:
    """Case-insensitive identity used by the seen-sets."""
    return F.lower(url)


def is_absolute(text: Column) -> Column:
    return text.rlike(_HAS_SCHEME)


def is_http(url: Column) -> Column:
    return url.rlike("(?i)^https?://")


def host(url: Column) -> Column:
    """Lower-case host without user info and port."""
    authority = F.regexp_extract(url, _URL, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), r":\d*$", ""))


def authority_prefix(url: Column) -> Column:
    """``scheme://authority`` part."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 3)


def same_host(url: Column, root_url: Column, same_host_only: Column) -> Column:
    return ~same_host_only | (host(url) == host(root_url))


def safe_host(url: Column) -> Column:
    """Host as a folder name."""
    return F.replace(host(url), F.lit(":"), F.lit("_"))


def site_folder(site: Column) -> Column:
    """Folder of a site's files. A site is named by its host, so this is the safe host."""
    return F.replace(site, F.lit(":"), F.lit("_"))


def fallback_title(url: Column) -> Column:
    """Readable words of the path, for pages without a title."""
    return F.replace(F.btrim(path(url), F.lit("/")), F.lit("-"), F.lit(" "))


def slug(url: Column) -> Column:
    """File-name stem made of path and query."""

    def flat(combined: Column) -> Column:
        marked = F.translate(F.regexp_replace(combined, "[^a-z0-9/_-]+", "_"), "/", "_")
        return F.btrim(F.regexp_replace(marked, "_{2,}", "_"), F.lit("_"))

    stem = F.lower(F.btrim(path(url), F.lit("/")))
    query = F.lower(F.regexp_replace(F.regexp_extract(url, _URL, 4), r"^\?+", ""))
    combined = F.when(query == "", stem).otherwise(F.concat(stem, F.lit("_"), query))
    return let(flat(combined), lambda s: F.when(s == "", F.lit("home")).otherwise(s))


def stable_filename(canonical: Column) -> Column:
    """Slug plus eight hash digits of the canonical URL."""
    return F.concat(slug(canonical), F.lit("_"), F.substring(F.sha2(canonical, 256), 1, 8), F.lit(".md"))


def page_path(file_name: Column) -> Column:
    """Path of a page file below its site folder."""
    return F.concat(F.lit("ai/pages/"), file_name)


def resolve(base: Column, href: Column) -> Column:
    """Absolute URL of one href on the page ``base``; null for anchors, mail and phone links."""
    return F.element_at(resolve_all(base, F.array(href)), 1)


def resolve_all(base: Column, hrefs: Column) -> Column:
    """Absolute URLs of all hrefs of the page ``base``, still to be canonicalised.

    Dot segments are left in: the canonical form removes them.
    """
    prefix = authority_prefix(base)
    folder = F.concat(prefix, F.regexp_replace(F.regexp_replace(path(base), "^$", "/"), "[^/]*$", ""))
    context = F.struct(
        F.regexp_extract(base, "^[^:]*:", 0).alias("scheme"),
        prefix.alias("prefix"),
        F.concat(prefix, path(base)).alias("page"),
        folder.alias("folder"),
    )
    anchored = let(context, lambda c: F.transform(hrefs, lambda h: F.struct(c.alias("at"), trim_ws(h).alias("h"))))
    return each(anchored, _RESOLVED)
