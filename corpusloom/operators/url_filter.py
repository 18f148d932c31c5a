"""Include and exclude patterns over URLs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import is_blank, trim_ws
from corpusloom.session import broadcast_if_small, materialize

GRAM = 4
"""Length of the literal fragments by which listed patterns meet URLs."""


def matches_pattern(url: Column, pattern: str) -> Column:
    """A pattern with ``*`` must match the whole URL; one without must occur in it. Case is ignored."""
    pattern = pattern.strip()
    if "*" in pattern:
        body = ".*".join(re.escape(piece) for piece in pattern.split("*"))
        return url.rlike(f"(?iu)^{body}$")
    return F.contains(F.lower(url), F.lower(F.lit(pattern)))


def url_allowed(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Exclude beats include; no include patterns allow everything; blank patterns match nothing."""

    def any_of(patterns: Sequence[str]) -> Column:
        hit = F.lit(False)
        for pattern in patterns:
            if pattern.strip():
                hit = hit | matches_pattern(url, pattern)
        return hit

    allowed = any_of(include) if include else F.lit(True)
    return ~any_of(exclude) & allowed


def _matches(url: Column, raw: Column) -> Column:
    p = trim_ws(raw)
    quoted = F.replace(F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q"))
    regex = F.concat(F.lit("(?iu)^\\Q"), quoted, F.lit("\\E$"))
    return ~is_blank(p) & F.when(F.contains(p, F.lit("*")), F.rlike(url, regex)).otherwise(F.contains(F.lower(url), F.lower(p)))


def _matches_any(url: Column, patterns: Column) -> Column:
    return F.coalesce(F.exists(patterns, lambda p: _matches(url, p)), F.lit(False))


def url_allowed_by(url: Column, include: Column, exclude: Column) -> Column:
    """The same rule with the pattern lists in columns, as for per-site options."""
    open_list = include.isNull() | (F.size(include) == 0)
    return ~_matches_any(url, exclude) & (open_list | _matches_any(url, include))


def _grams(text: Column) -> Column:
    """Distinct fragments of ``GRAM`` characters; none of a shorter text."""
    starts = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - GRAM + 1))
    fragments = F.transform(starts, lambda i: F.substring(text, i, F.lit(GRAM)))
    return F.coalesce(F.array_distinct(fragments), F.array().cast("array<string>"))


def _is_ascii(text: Column) -> Column:
    return F.length(text) == F.octet_length(text)


def pattern_keys(patterns: DataFrame) -> DataFrame:
    """Usable patterns of ``(site, is_exclude, pattern)`` with ``gram``, the fragment that fewest of the site's hold.

    A pattern without a fragment of ``GRAM`` characters between its asterisks, or with characters beyond ASCII, which can
    equal others when case is ignored, has the empty fragment.
    """
    usable = patterns.select("site", "is_exclude", trim_ws(F.col("pattern")).alias("pattern")).filter(~is_blank(F.col("pattern")))
    pieces = F.split(F.lower("pattern"), r"\*")
    grams = F.array_distinct(F.flatten(F.transform(pieces, _grams)))
    grams = F.when(_is_ascii(F.col("pattern")) & (F.size(grams) > 0), grams).otherwise(F.array(F.lit("")))
    held = usable.distinct().select("site", "is_exclude", "pattern", F.explode(grams).alias("gram"))
    held = materialize(held, "fragments")
    counts = held.groupBy("site", "gram").agg(F.count("*").alias("n"))
    rarest = F.min_by("gram", F.struct("n", "gram")).alias("gram")
    return materialize(held.join(counts, ["site", "gram"]).groupBy("site", "is_exclude", "pattern").agg(rarest), "patterns")


def allowed_by_list(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rows of ``pages`` (``site``, ``url`` and more) that the listed patterns of their site allow.

    ``patterns`` has ``(site, is_exclude, pattern)`` and may hold very many of a site: a URL is tested against
    those alone whose rarest fragment it holds. The rule is that of :func:`url_allowed_by`: exclude beats include; a site
    without include rows allows everything, one with blank ones only allows nothing. A null URL is never matched.
    """
    keys = pattern_keys(patterns)
    urls = materialize(pages.select("site", "url").filter("url IS NOT NULL").distinct(), "urls")
    plain = _is_ascii(F.col("url"))
    fragments = F.array_append(_grams(F.lower("url")), F.lit(""))
    near = urls.filter(plain).select("site", "url", F.explode(fragments).alias("gram")).join(broadcast_if_small(keys), ["site", "gram"])
    other = urls.filter(~plain).join(keys, "site")
    pairs = near.unionByName(other).filter(_matches(F.col("url"), F.col("pattern")))
    hits = pairs.groupBy("site", "url").agg(F.bool_or("is_exclude").alias("_out"), F.bool_or(~F.col("is_exclude")).alias("_in"))
    closed = materialize(patterns.filter("NOT is_exclude").select("site").distinct(), "closed")
    closed = broadcast_if_small(closed.withColumn("_closed", F.lit(True)))
    judged = pages.join(materialize(hits, "hits"), ["site", "url"], "left").join(closed, "site", "left")
    out, included, is_closed = (F.coalesce(c, F.lit(False)) for c in ("_out", "_in", "_closed"))
    return judged.filter(~out & (~is_closed | included)).select(*pages.columns)
