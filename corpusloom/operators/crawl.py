"""Breadth-first walk of the link graph of every site at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.operators.ranking import first_by_key, first_n
from corpusloom.operators.url_filter import url_allowed_by
from corpusloom.session import BROADCAST_ROWS, materialize


def crawl_bfs(edges: DataFrame, sites: DataFrame) -> DataFrame:
    """The first ``max_pages`` URLs of each site in breadth-first order, at most ``max_depth`` links away.

    ``edges`` are link lists ``(site, src_key, links)`` as made by :func:`corpusloom.operators.links.adjacency`.
    Each level is one join of the frontier with the link lists. A URL belongs to the level that reaches
    it first, and within the level to the parent of lowest rank and its earliest link. Pages without a
    capture are leaves. Only the root is subject to the URL patterns. The levels are written to shared
    scratch, which keeps lineage short and lets a lost executor resume from the level before.
    """
    roots = sites.filter(
        F.col("root_url").isNotNull() & url_allowed_by(F.col("root_url"), F.col("include"), F.col("exclude"))
    )
    lists = materialize(edges, "edges")
    frontier = seen = roots.select(
        "site",
        F.col("root_url").alias("url"),
        U.url_key(F.col("root_url")).alias("url_key"),
        F.lit(0).alias("depth"),
        F.lit(1).alias("rank"),
        "max_pages",
        "max_depth",
    )
    deepest, widest = (value or 0 for value in sites.agg(F.max("max_depth"), F.max("max_pages")).first())
    for depth in range(1, deepest + 1):
        size = frontier.count()
        if size == 0:
            break
        used = seen.groupBy("site").agg(F.max("rank").alias("used"))
        # Sites whose budget is used up, or that may go no deeper, drop out here.
        sources = (
            frontier.join(used, "site")
            .filter((F.col("used") < F.col("max_pages")) & (F.col("max_depth") >= depth))
            .select("site", F.col("url_key").alias("src_key"), F.col("rank").alias("parent"), "used", "max_pages", "max_depth")
        )
        sources = F.broadcast(sources) if size <= BROADCAST_ROWS else sources
        reached = (
            lists.join(sources, ["site", "src_key"])
            .select("site", "parent", "used", "max_pages", "max_depth", F.posexplode("links").alias("link_ord", "url"))
            .withColumn("url_key", U.url_key(F.col("url")))
        )
        fresh = first_by_key(reached, ["site", "url_key"], ["parent", "link_ord"]).join(
            seen.select("site", "url_key"), ["site", "url_key"], "left_anti"
        )
        level = (
            first_n(fresh, ["site"], ["parent", "link_ord"], widest, "place")
            .withColumn("rank", (F.col("used") + F.col("place")).cast("int"))
            .filter(F.col("rank") <= F.col("max_pages"))
            .select("site", "url", "url_key", F.lit(depth).alias("depth"), "rank", "max_pages", "max_depth")
        )
        frontier = materialize(level, "crawl")
        seen = seen.unionByName(frontier)
    return seen.select(
        "site",
        "url",
        F.lit("crawl").alias("discovery_method"),
        "depth",
        F.col("rank").cast("bigint").alias("ordinal"),
    )
