"""URLs listed by RSS and Atom feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.functions.text import is_blank, trim_ws
from corpusloom.operators.merge import distinct_by_url, take_max_pages
from corpusloom.options import BuildOptions
from corpusloom.session import materialize
from corpusloom.sources.tables import success, with_site

# Where feeds are looked for, in order.
FEED_PATHS = ("/feed/", "/rss", "/rss.xml", "/feed.xml")

_SCHEMA = (
    "channel STRUCT<item: ARRAY<STRUCT<link: ARRAY<STRING>, guid: STRUCT<_VALUE: STRING, _isPermaLink: STRING>>>>, "
    "entry ARRAY<STRUCT<link: ARRAY<STRUCT<_href: STRING>>>>"
)

# Places of a URL: page of the feed in its high half, entry in its low half.
_DOC = 1 << 32


def _first_links(xml: Column) -> Column:
    """First link per item. A permanent ``guid`` stands in for a missing RSS link."""

    def rss(item: Column) -> Column:
        link = F.get(F.filter(F.transform(item["link"], trim_ws), lambda v: ~is_blank(v)), F.lit(0))
        permanent = F.coalesce(F.lower(item["guid"]["_isPermaLink"]), F.lit("true")) != "false"
        return F.coalesce(link, F.when(permanent, F.nullif(trim_ws(item["guid"]["_VALUE"]), F.lit(""))))

    def atom(entry: Column) -> Column:
        return F.get(F.transform(entry["link"], lambda link: trim_ws(link["_href"])), F.lit(0))

    none = F.array().cast("array<string>")
    links = F.concat(
        F.coalesce(F.transform(xml["channel"]["item"], rss), none),
        F.coalesce(F.transform(xml["entry"], atom), none),
    )
    return F.filter(links, lambda link: link.isNotNull())


def scan_feeds(site_docs: DataFrame, sites: DataFrame, options: BuildOptions) -> DataFrame:
    """URLs of the first feed candidate that yields any, page after page; a document with a relative link yields none.

    The documents of a candidate are told apart by ``page_no``. Each is read where it lies and only the candidates' numbers
    are compared, so a feed of many pages is never put together.
    """
    docs = site_docs.filter((F.col("kind") == "feed") & success(F.col("status")) & ~is_blank(F.col("body")))
    xml = F.from_xml("body", _SCHEMA, {"ignoreNamespace": "true"})
    urls = F.filter(
        U.canonicalize_all(F.col("links")),
        lambda u: u.isNotNull() & U.is_http(u) & U.same_host(u, F.col("root_url"), F.col("same_host_only")),
    )
    readable = F.forall("links", U.is_absolute)
    document = ["site", "candidate_ord", "page_no"]
    parsed = (
        with_site(docs, sites.select("site", "root_url", "same_host_only"), "doc_url")
        .select(*document, "root_url", "same_host_only", xml.alias("xml"))
        .withColumn("links", _first_links(F.col("xml")))
        .select(*document, readable.alias("readable"), urls.alias("urls"))
    )
    yields = F.col("readable") & (F.size("urls") > 0) & F.col("candidate_ord").isNotNull()
    listed = materialize(parsed.groupBy(*document).agg(F.min(F.when(yields, F.col("urls"))).alias("urls")), "feeds").filter("urls is not null")
    firsts = materialize(listed.groupBy("site").agg(F.min("candidate_ord").alias("first")), "candidates")
    place = F.coalesce(F.col("page_no"), F.lit(0)).cast("bigint") * F.lit(_DOC) + F.col("pos")
    found = (
        with_site(listed, firsts, "page_no")
        .filter(F.col("candidate_ord") == F.col("first"))
        .select("site", "page_no", F.posexplode("urls").alias("pos", "url"))
        .select("site", place.alias("ordinal"), "url")
    )
    return take_max_pages(distinct_by_url(found), sites).select(
        "site", "url", F.lit("rss").alias("discovery_method"), F.lit(0).alias("depth"), "ordinal"
    )
