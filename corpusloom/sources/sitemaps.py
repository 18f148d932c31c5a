"""URLs listed by sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.functions.binding import once
from corpusloom.functions.text import is_blank, trim_ws
from corpusloom.operators.merge import distinct_by_url, take_max_pages
from corpusloom.options import BuildOptions
from corpusloom.sources.tables import success, with_site

# Where sitemaps are looked for, in order.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml")

_SCHEMA = "url ARRAY<STRUCT<loc: ARRAY<STRING>>>, sitemap ARRAY<STRUCT<loc: ARRAY<STRING>>>"
# Places of a URL: document in its high half, entry in its low half.
_DOC = 1 << 32


def _locations(entries: Column) -> Column:
    firsts = F.transform(entries, lambda e: trim_ws(F.get(e["loc"], F.lit(0))))
    return F.coalesce(F.filter(firsts, lambda loc: ~is_blank(loc)), F.array().cast("array<string>"))


def read_sitemap_docs(site_docs: DataFrame, sites: DataFrame) -> DataFrame:
    """Every readable sitemap document with its sub-sitemaps and its usable page URLs as arrays."""
    docs = site_docs.filter((F.col("kind") == "sitemap") & success(F.col("status")) & ~is_blank(F.col("body")))
    xml = F.from_xml("body", _SCHEMA, {"ignoreNamespace": "true"})
    urls = F.filter(
        U.canonicalize_all(F.col("locations")),
        lambda u: u.isNotNull() & U.is_http(u) & U.same_host(u, F.col("root_url"), F.col("same_host_only")),
    )
    parsed = (
        with_site(docs, sites.select("site", "root_url", "same_host_only"), "doc_url")
        .select("site", "doc_url", "candidate_ord", "root_url", "same_host_only", xml.alias("xml"))
        .withColumns({"subs": _locations(F.col("xml.sitemap")), "locations": _locations(F.col("xml.url"))})
    )
    return once(parsed, subs=F.col("subs"), urls=urls).select("site", "doc_url", "candidate_ord", "subs", "urls")


def scan_sitemaps(site_docs: DataFrame, sites: DataFrame, options: BuildOptions) -> DataFrame:
    """URLs of the first candidate document that yields any.

    An index counts as yielding even when its sub-sitemaps hold nothing, unless one of its entries
    is no URL at all. Sub-sitemaps are read one level deep; a missing one adds nothing.
    """
    docs = read_sitemap_docs(site_docs, sites)
    is_index = F.size("subs") > 0
    broken = F.exists("subs", lambda s: ~U.is_absolute(s))
    yields = F.when(is_index, ~broken).otherwise(F.size("urls") > 0) & F.col("candidate_ord").isNotNull()
    winners = (
        docs.groupBy("site")
        .agg(F.min_by(F.struct("subs", "urls"), F.when(yields, F.col("candidate_ord"))).alias("w"))
        .select("site", "w.subs", "w.urls")
    )
    direct = winners.filter(~is_index).select("site", F.posexplode("urls").alias("ordinal", "url"))
    # An entry may spell its document's host or port in another way than the stored response does.
    address = U.canonicalize(F.col("doc_url")).alias("address")
    subs = winners.select("site", F.posexplode("subs").alias("sub_ord", "doc_url")).select("site", "sub_ord", address)
    listed = (
        subs.join(docs.select("site", address, "urls"), ["site", "address"])
        .select("site", "sub_ord", F.posexplode("urls").alias("pos", "url"))
        .select("site", (F.col("sub_ord").cast("bigint") * F.lit(_DOC) + F.col("pos")).alias("ordinal"), "url")
    )
    found = direct.select("site", F.col("ordinal").cast("bigint").alias("ordinal"), "url").unionByName(listed)
    return take_max_pages(distinct_by_url(found), sites).select(
        "site", "url", F.lit("sitemap").alias("discovery_method"), F.lit(0).alias("depth"), "ordinal"
    )
