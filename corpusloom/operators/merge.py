"""Distinct URLs, page budgets and the precedence merge of discovery strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.operators.ranking import first_by_key, first_n
from corpusloom.operators.url_filter import url_allowed_by
from corpusloom.sources.tables import with_site


def distinct_by_url(found: DataFrame, order: Sequence[str] = ("ordinal",)) -> DataFrame:
    """First occurrence of every URL of a site; URLs differing in case stay apart."""
    return first_by_key(found, ["site", "url"], order).select(*found.columns)


def widest_budget(sites: DataFrame) -> int:
    """The largest ``max_pages`` of all sites: no rank beyond it is of use."""
    return sites.agg(F.max("max_pages")).first()[0] or 1


def take_max_pages(found: DataFrame, sites: DataFrame, order: Sequence[str] = ("ordinal",), rank: str = "rank") -> DataFrame:
    """The first ``max_pages`` rows of every site, with their rank.

    Ranks beyond the largest budget are pruned before the shuffle, then each site's own budget holds.
    """
    bounded = first_n(found, ["site"], order, widest_budget(sites), rank)
    budget = sites.select("site", "max_pages")
    return bounded.join(budget, "site").filter(F.col(rank) <= F.col("max_pages")).drop("max_pages")


def merge_strategies(strategies: Sequence[DataFrame], sites: DataFrame) -> DataFrame:
    """Union in order of precedence, filtered, one row per URL ignoring case, cut at the page budget."""
    tagged = [
        s.select("site", "url", "discovery_method", "depth", "ordinal", F.lit(i).alias("priority"))
        for i, s in enumerate(strategies)
    ]
    union = tagged[0]
    for more in tagged[1:]:
        union = union.unionByName(more)
    rules = sites.select("site", "include", "exclude")
    allowed = (
        with_site(union, rules, "url")
        .filter(url_allowed_by(F.col("url"), F.col("include"), F.col("exclude")))
        .drop("include", "exclude")
    )
    keyed = allowed.withColumn("url_key", U.url_key(F.col("url")))
    firsts = first_by_key(keyed, ["site", "url_key"], ["priority", "ordinal"])
    return take_max_pages(firsts, sites, ["priority", "ordinal"]).select(
        "site", "url", "url_key", "discovery_method", "depth", "priority", "ordinal", "rank"
    )


def dry_run_list(discovered: DataFrame, sites: DataFrame) -> DataFrame:
    """Numbered URLs a run would process; nothing downstream is planned."""
    return (
        discovered.join(sites.select("site", "max_pages"), "site")
        .filter(F.col("rank") <= F.col("max_pages"))
        .select("site", "rank", "url")
    )
