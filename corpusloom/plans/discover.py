"""URL discovery over all strategies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.operators.crawl import crawl_bfs
from corpusloom.operators.links import adjacency, link_lists
from corpusloom.operators.merge import merge_strategies
from corpusloom.operators.ranking import first_by_key
from corpusloom.operators.triage import choose_captures
from corpusloom.options import BuildOptions
from corpusloom.session import broadcast_if_small, materialize, materialize_all
from corpusloom.sources.channels import effective_docs
from corpusloom.sources.feeds import scan_feeds
from corpusloom.sources.rest import RestListing, scan_rest_items
from corpusloom.sources.sitemaps import scan_sitemaps


Strategy = Callable[[DataFrame, DataFrame, BuildOptions], DataFrame]


@dataclass(frozen=True)
class Discovery:
    urls: DataFrame
    rest: RestListing
    chosen: DataFrame


def last_items(rest_items: DataFrame) -> DataFrame:
    """REST items with one per URL ignoring case: the last. Their HTML joins the places that were found without it."""
    keyed = rest_items.withColumn("url_key", U.url_key(F.col("url")))
    places = keyed.groupBy("site", "url_key").agg(F.max("ordinal").alias("ordinal"))
    return keyed.join(places, ["site", "url_key", "ordinal"])


def capture_edges(captures: DataFrame, chosen: DataFrame, rest_items: DataFrame, sites: DataFrame) -> DataFrame:
    """Link lists of all pages a crawl could meet: REST-rendered pages first, else the chosen captures.

    Links are taken from every capture in place; only the lists, not the bodies, meet the narrow table
    of chosen captures.
    """
    rendered = rest_items.select("site", "url", "html")
    rest_lists = adjacency(rendered, sites)
    pages = captures.select("capture_id", "site", U.canonicalize(F.col("url")).alias("url"), F.col("body").alias("html"))
    lists = link_lists(pages, sites, keep=["capture_id"]).filter(F.size("links") > 0).drop("url")
    # Of pages whose URLs differ in case the crawl meets one; the first by URL is as good as any and the same each time.
    usable = chosen.filter(F.col("capture_id").isNotNull()).select("site", "url_key", "url", "capture_id")
    firsts = first_by_key(usable, ["site", "url_key"], ["url"])
    used = firsts.select("capture_id", F.col("url_key").alias("src_key"))
    captured = lists.join(used, "capture_id").select("site", "src_key", "links")
    keys = rest_items.select("site", U.url_key(F.col("url")).alias("src_key"))
    return rest_lists.unionByName(captured.join(keys, ["site", "src_key"], "left_anti"))


def discover_composite(
    sites: DataFrame,
    captures: DataFrame,
    site_docs: DataFrame,
    options: BuildOptions,
    strategies: Sequence[Strategy] = (scan_sitemaps, scan_feeds),
) -> Discovery:
    """REST listing, then ``strategies`` (sitemap, feed), then crawl, in this order of precedence.

    A strategy maps ``(site_docs, sites, options)`` to ``(site, url, discovery_method, depth, ordinal)``.
    ``sites`` comes from :func:`corpusloom.sources.tables.with_site_defaults`. Sites whose budget the listings
    already fill are not crawled; the result is the same, as the merge would cut the crawl's URLs.
    """
    site_docs = effective_docs(site_docs)
    rest = scan_rest_items(site_docs, sites, options)
    listings = [rest.discovered, *[strategy(site_docs, sites, options) for strategy in strategies]]
    tables = [(choose_captures(captures), "chosen"), *[(found, "listing") for found in listings]]
    chosen, *listings = materialize_all(tables)
    merged = merge_strategies(listings, sites)
    used = merged.groupBy("site").agg(F.max("rank").alias("used"))
    filled = materialize(used.join(sites, "site").filter("used >= max_pages").select("site"), "filled")
    open_sites = sites.join(filled, "site", "left_anti")
    # Captures of sites that are not crawled are dropped before their links are taken.
    candidates = captures.join(broadcast_if_small(filled), "site", "left_anti")
    edges = capture_edges(candidates, chosen, last_items(rest.items), sites)
    listings.append(crawl_bfs(edges, open_sites))
    return Discovery(materialize(merge_strategies(listings, sites), "discovered"), rest, chosen)
