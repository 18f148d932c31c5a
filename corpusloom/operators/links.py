"""Links of captured pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import url as U
from corpusloom.functions.binding import once
from corpusloom.sources.tables import with_site


def link_lists(pages: DataFrame, sites: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per page with its distinct outgoing links in document order, and the ``keep`` columns.

    ``pages`` has ``site``, canonical ``url`` and ``html``. Links are found, resolved, made canonical and
    de-duplicated inside the row, so nothing wide is shuffled.
    """
    roots = sites.select("site", "root_url", "same_host_only")
    rooted = with_site(pages.select(*keep, "site", "url", "html"), roots, "url")
    links = H.page_links(F.col("html"), F.col("url"), F.col("root_url"), F.col("same_host_only"))
    return once(rooted, links=links).select(*keep, "site", "url", "links")


def scan_links(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per page and link, numbered in document order."""
    return link_lists(pages, sites).select("site", "url", F.posexplode("links").alias("link_ord", "link"))


def adjacency(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Link lists keyed for lookup by page, without pages that link nowhere."""
    return (
        link_lists(pages, sites)
        .filter(F.size("links") > 0)
        .select("site", U.url_key(F.col("url")).alias("src_key"), "links")
    )
