"""Which stored response stands for a page: gates, challenge labels, rendered fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import url as U
from corpusloom.functions.binding import once
from corpusloom.functions.text import is_blank
from corpusloom.operators.merge import distinct_by_url
from corpusloom.operators.ranking import first_by_key
from corpusloom.session import broadcast_if_small
from corpusloom.sources.tables import PRIMARY, RENDERED

FETCH_FAILED = "FetchFailed"


def filter_response(captures: DataFrame) -> DataFrame:
    """Captures whose response can become a page."""
    return captures.filter(H.accepts_response(F.col("status"), F.col("content_type"), F.col("body")))


def scan_captures(captures: DataFrame) -> DataFrame:
    """Page shells of usable captures: canonical URL, title, HTML."""
    usable = once(filter_response(captures), url=U.canonicalize(F.col("url"))).filter(F.col("url").isNotNull())
    return usable.select(
        "capture_id", "site", "url", page_title().alias("title"), F.col("body").alias("html"), "fetched_at"
    )


def page_title() -> Column:
    """Title of a capture. A rendered page keeps an empty title; others fall back to the path."""
    body, url = F.col("body"), F.col("url")
    rendered = F.coalesce(H.html_title_regex(body), U.fallback_title(url))
    return F.when(F.col("channel") == RENDERED, rendered).otherwise(H.html_title(body, url))


def _usable() -> Column:
    """Whether a response can stand for its page: plain ones by status, type and body, rendered ones unless blank."""
    accepted = H.accepts_response(F.col("status"), F.col("content_type"), F.col("body"))
    return F.when(F.col("channel") == PRIMARY, accepted).otherwise(~is_blank(F.col("body")))


def usable_shells(captures: DataFrame) -> DataFrame:
    """Page shells of all responses that could stand for their pages."""
    usable = once(captures.filter(_usable()), url=U.canonicalize(F.col("url"))).filter(F.col("url").isNotNull())
    return usable.select("capture_id", "site", "url", page_title().alias("title"), F.col("body").alias("html"), "fetched_at")


def capture_flags(captures: DataFrame) -> DataFrame:
    """Per site and URL the response of each channel that counts, as the structs ``p`` (plain) and ``r`` (rendered).

    The latest counts, of equals the last attempt, and then the lowest ``capture_id``. That order comes first in the
    structs, so the flags of two sets of captures are merged by taking the least. Bodies are only looked at where they
    lie: what is shuffled are flags.
    """
    flags = once(captures, url=U.canonicalize(F.col("url"))).filter(F.col("url").isNotNull()).select("site", "url", "channel", capture_flag().alias("c"))
    return least_flags(flags, F.col("c"))


def capture_flag() -> Column:
    """What decides about a response, in the order in which responses count."""
    body = F.col("body")
    return F.struct(
        (-F.unix_micros("fetched_at")).alias("age"),
        (-F.col("attempt")).alias("last"),
        "capture_id",
        _usable().alias("usable"),
        H.detect_challenge(body).alias("challenge"),
        H.is_too_thin(body).alias("thin"),
    )


def least_flags(flags: DataFrame, flag: Column) -> DataFrame:
    """The least flag of each channel per site and URL."""
    return flags.groupBy("site", "url").agg(
        F.min(F.when(F.col("channel") == PRIMARY, flag)).alias("p"), F.min(F.when(F.col("channel") == RENDERED, flag)).alias("r")
    )


def flagged_shells(captures: DataFrame) -> DataFrame:
    """Page shells of all responses with their flags; HTML only of those that can stand for their pages."""
    known = once(captures, url=U.canonicalize(F.col("url"))).filter(F.col("url").isNotNull())
    return known.select(
        "capture_id", "site", "url", "channel", page_title().alias("title"), F.when(_usable(), F.col("body")).alias("html"), "fetched_at", capture_flag().alias("flag")
    )


def choose_captures(captures: DataFrame) -> DataFrame:
    """One narrow row per captured page: which response to use and why.

    The plain response is used unless it was rejected, shows a challenge or is too thin; then the rendered one, if any.
    """
    return choose_by_flags(capture_flags(captures))


def _with_choice(flags: DataFrame) -> DataFrame:
    """Flags with the ``channel`` that is used, null where neither response can be, and why."""
    primary = F.coalesce(F.col("p.usable"), F.lit(False))
    rendered = F.coalesce(F.col("r.usable"), F.lit(False))
    reason = (
        F.when(~primary, F.lit("failed"))
        .when(F.col("p.challenge").isNotNull(), F.lit("challenge"))
        .when(F.col("p.thin"), F.lit("thin"))
    )
    use_rendered = F.col("fallback_reason").isNotNull() & F.col("rendered")
    known = flags.withColumns({"fallback_reason": reason, "primary": primary, "rendered": rendered})
    return known.withColumn("channel", F.when(use_rendered, F.lit(RENDERED)).when(F.col("primary"), F.lit(PRIMARY)))


def chosen_flags(flags: DataFrame) -> DataFrame:
    """Flags with ``c``, that of the response which stands for the page; null where there is none."""
    used = F.when(F.col("channel") == RENDERED, F.col("r")).when(F.col("channel") == PRIMARY, F.col("p"))
    return _with_choice(flags).select(*flags.columns, used.alias("c"))


def choose_by_flags(flags: DataFrame) -> DataFrame:
    """:func:`choose_captures` from the flags of :func:`capture_flags`."""
    still_blocked = F.coalesce((F.col("channel") == RENDERED) & F.col("r.challenge").isNotNull(), F.lit(False))
    return _with_choice(flags).select(
        "site",
        "url",
        U.url_key(F.col("url")).alias("url_key"),
        "channel",
        F.when(F.col("channel") == RENDERED, F.col("r.capture_id")).when(F.col("channel") == PRIMARY, F.col("p.capture_id")).alias("capture_id"),
        "fallback_reason",
        F.when(F.col("primary"), F.col("p.challenge")).alias("challenge"),
        still_blocked.alias("still_blocked"),
    )


def match_captures(wanted: DataFrame, chosen: DataFrame) -> DataFrame:
    """``wanted`` rows (``site``, ``url``, ``url_key`` and more) with the ``capture_id`` that stands for their URL.

    The capture of the exact URL counts; only without one, that of the first URL which differs in case.
    """
    usable = chosen.filter(F.col("capture_id").isNotNull())
    exact = usable.select("site", "url", F.col("capture_id").alias("_exact"))
    alike = first_by_key(usable.select("site", "url_key", "url", "capture_id"), ["site", "url_key"], ["url"])
    alike = alike.select("site", "url_key", F.col("capture_id").alias("_alike"))
    captured = chosen.select("site", "url", F.lit(True).alias("_captured"))
    found = wanted.join(exact, ["site", "url"], "left").join(captured, ["site", "url"], "left").join(alike, ["site", "url_key"], "left")
    # A captured URL without a usable response has failed; another URL's response does not stand for it.
    other = F.when(F.col("_captured").isNull(), F.col("_alike"))
    return found.withColumn("capture_id", F.coalesce("_exact", other)).drop("_exact", "_alike", "_captured")


def join_capture_fallback(captures: DataFrame, chosen: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Page shells of the chosen captures, with the ``carry`` columns of ``chosen``, a stored table.

    Few ids are broadcast, so bodies stay where they were read. Otherwise the join is on ``capture_id``,
    which spreads evenly however the pages divide over sites.
    """
    ids = chosen.filter(F.col("capture_id").isNotNull()).select("capture_id", F.col("url").alias("page_url"), *carry)
    return captures.join(broadcast_if_small(ids), "capture_id").withColumn("url", F.col("page_url")).select(
        "capture_id", "site", "url", page_title().alias("title"), F.col("body").alias("html"), "fetched_at", *carry
    )


def protection_labels(captures: DataFrame, sites: DataFrame) -> DataFrame:
    """Challenge label on the root page of every site; null where the root answers normally."""
    roots = sites.select("site", F.col("root_url").alias("url"))
    plain = once(captures.filter(F.col("channel") == PRIMARY), url=U.canonicalize(F.col("url")))
    probes = plain.select("site", "url", "capture_id", H.detect_challenge(F.col("body")).alias("label"))
    answered = distinct_by_url(probes.join(roots, ["site", "url"], "left_semi"), ["capture_id"])
    return roots.join(answered, ["site", "url"], "left").select("site", "label")


def protection_report(labels: DataFrame) -> DataFrame:
    """Number of sites per challenge label."""
    return labels.groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(F.count("*").alias("sites"))
