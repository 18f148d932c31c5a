"""A crawl archive derived from the ``pages`` table, for the registered queries.

The table holds page captures only. Sitemaps, feeds, REST listings, home pages and imperfect responses
are made from its rows, all of them, by rules on the URL and host. A site is a host, however many rows it
has. Its pages, in order of their ids, are dealt to blocks of 1, 3, 5, 7, ... pages: a site of ``n`` pages has
about the square root of ``n`` blocks of at most twice as many pages. Sub-sitemaps, pages of feeds and part pages list
one block each, indexes, feeds of one page and home pages one entry a block, so that no document lists a site's pages
whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import url as U
from corpusloom.operators.ranking import ordered_rank
from corpusloom.session import materialize
from corpusloom.sources.tables import PRIMARY, RENDERED

LISTING = 3
RENDERED_IDS = 1_000_000_000_000
WHOLE = 2_000_000_000
"""A page budget above the size of any site."""
BUDGETS = (None, 25, WHOLE)
"""Page budget of a site by the length of its name: the run's own, a tight one, the whole site."""
TREES = ((40, 3), (WHOLE, 12), (1_000, 4))
"""Budget and depth of each site of links: a tight budget, the whole site, and a tight depth."""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their site and the shape of their URL."""
    url = F.col("url")
    shape = (
        F.when(url.endswith(".html"), "html")
        .when(url.endswith("#top"), "anchor")
        .when(url.endswith("utm_source=feed"), "feed")
        .when(F.contains(url, F.lit("?page=2")), "paged")
        .when(url.endswith("/"), "slash")
        .otherwise("plain")
    )
    host = U.host(url)
    return read(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        "html",
        host.alias("host"),
        host.alias("site"),
        shape.alias("shape"),
    )


def _root() -> Column:
    return F.concat(F.lit("https://"), F.col("host"), F.lit("/"))


def sites_of(pages: DataFrame) -> DataFrame:
    own = F.get(F.array(*[F.lit(budget).cast("int") for budget in BUDGETS]), F.length("site") % len(BUDGETS))
    return pages.select("site", _root().alias("root_url"), own.alias("max_pages")).distinct()


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of every site with their pages as arrays, stored."""
    ranked = ordered_rank(pages.select("site", "host", "page_id", "url", "shape"), ["site"], [F.col("page_id")], "place")
    block = F.floor(F.sqrt(F.col("place") - 1)).cast("int")
    entries = F.array_sort(F.collect_list(F.struct("page_id", "url", "shape")))
    return materialize(ranked.groupBy("site", "host", block.alias("block")).agg(entries.alias("entries")), "blocks")


def _heads(blocks: DataFrame) -> DataFrame:
    """Sites with the first and the last page of each block."""
    head = F.struct("block", F.get("entries", F.lit(0)).alias("first"), F.element_at("entries", -1).alias("last"))
    return blocks.groupBy("site", "host").agg(F.array_sort(F.collect_list(head)).alias("heads"))


def _document(kind: str, path: str | Column, body: Column, **given) -> Column:
    values = {"candidate_ord": None, "page_no": None, "total_pages": None, "status": 200, **given}
    return F.struct(
        F.lit(kind).alias("kind"),
        F.concat(F.lit("https://"), F.col("host"), path if isinstance(path, Column) else F.lit(path)).alias("doc_url"),
        *[F.lit(values[c]).cast("int").alias(c) for c in ("candidate_ord", "page_no", "total_pages", "status")],
        F.lit(given.get("content_type", "application/xml")).alias("content_type"),
        body.alias("body"),
    )


def _xml(text: Column) -> Column:
    return F.replace(text, F.lit("&"), F.lit("&amp;"))


def _urlset(entries: Column, tag: str = "") -> Column:
    rows = F.transform(
        entries, lambda e: F.concat(F.lit(f"<{tag}url><{tag}loc> "), _xml(e["url"]), F.lit(f"</{tag}loc></{tag}url>"))
    )
    space = f' xmlns:{tag[:-1]}="http://www.sitemaps.org/schemas/sitemap/0.9"' if tag else ""
    return F.concat(F.lit(f'<?xml version="1.0"?><{tag}urlset{space}>'), F.array_join(rows, ""), F.lit(f"</{tag}urlset>"))


def _as_docs(listed: DataFrame, variants: list[list[Column]]) -> DataFrame:
    """One row per document of the variant the host's name length picks."""
    turn = F.length("host") % len(variants)
    docs = F.when(F.lit(False), F.array(*variants[0]))
    for i, documents in enumerate(variants):
        docs = docs.when(turn == i, F.array(*documents))
    return listed.select("site", F.inline(docs))


def sitemap_docs(blocks: DataFrame) -> DataFrame:
    """By the host's name length: an index of the blocks; a malformed document then an index with a missing child, of
    two children a block; an empty urlset then a prefixed one of the first page of each block; a refused one.
    """
    entries = F.col("entries")
    dotted = F.filter(entries, lambda e: e["shape"].isin("html", "slash"))
    others = F.filter(entries, lambda e: ~e["shape"].isin("html", "slash"))
    fronts = F.transform("heads", lambda h: h["first"])

    def name(kind: str, block: Column) -> Column:
        return F.concat(F.lit(f"/sitemap-{kind}"), block.cast("string"), F.lit(".xml"))

    def child(path: Column) -> Column:
        return F.concat(F.lit("<sitemap><loc>https://"), F.col("host"), path, F.lit("</loc></sitemap>"))

    def children(kind: str) -> Column:
        return F.array_join(F.transform("heads", lambda h: child(name(kind, h["block"]))), "")

    def index(*parts: Column) -> Column:
        return F.concat(F.lit("<sitemapindex>"), *parts, F.lit("</sitemapindex>"))

    def part(kind: str, listed: Column) -> Column:
        return _document("sitemap", name(kind, F.col("block")), _urlset(listed))

    roots = _as_docs(
        _heads(blocks),
        [
            [_document("sitemap", "/sitemap.xml", index(children("")), candidate_ord=1)],
            [
                _document("sitemap", "/sitemap.xml", F.lit("<urlset><url><loc>"), candidate_ord=1),
                _document(
                    "sitemap",
                    "/sitemap_index.xml",
                    index(children("a"), child(F.lit("/sitemap-missing.xml")), children("b")),
                    candidate_ord=2,
                ),
            ],
            [
                _document("sitemap", "/sitemap.xml", F.lit("<urlset></urlset>"), candidate_ord=1),
                _document("sitemap", "/wp-sitemap.xml", _urlset(fronts, "sm:"), candidate_ord=3),
            ],
            [_document("sitemap", "/sitemap.xml", _urlset(fronts), candidate_ord=1, status=404)],
        ],
    )
    indexed = blocks.filter(F.length("host") % 4 < 2)
    turn = F.length("host") % 4
    parts = F.when(turn == 0, F.array(part("", entries))).otherwise(F.array(part("a", dotted), part("b", others)))
    return roots.unionByName(indexed.select("site", F.inline(parts)))


def feed_docs(blocks: DataFrame) -> DataFrame:
    """The last page of each block, in one feed a site."""
    return _feeds(_heads(blocks), F.transform("heads", lambda h: h["last"]))


def feed_pages(blocks: DataFrame) -> DataFrame:
    """Every page, in a feed of a site whose pages list one block each."""
    return _feeds(blocks, F.col("entries"), F.col("block") + 1)


def _feeds(listed: DataFrame, entries: Column, page_no: Column | None = None) -> DataFrame:
    """By the host's name length: as RSS with links; as empty RSS then Atom; as RSS with a guid only, permanent where the
    URL has no query.
    """

    def items(body) -> Column:
        return F.array_join(F.transform(entries, body), "")

    rss = items(lambda e: F.concat(F.lit("<item><link>"), _xml(e["url"]), F.lit("</link><guid>x</guid></item>")))
    atom = items(
        lambda e: F.concat(F.lit('<entry><link href="'), _xml(e["url"]), F.lit('"/><link rel="edit" href="https://e.x/"/></entry>'))
    )
    guid = items(
        lambda e: F.concat(
            F.lit('<item><guid isPermaLink="'),
            F.when(F.contains(e["url"], F.lit("?")), F.lit("false")).otherwise(F.lit("true")),
            F.lit('">'),
            _xml(e["url"]),
            F.lit("</guid></item>"),
        )
    )

    def as_rss(inner: Column) -> Column:
        return F.concat(F.lit('<rss version="2.0"><channel><title>t</title>'), inner, F.lit("</channel></rss>"))

    def feed(path: str, body: Column, order: int) -> Column:
        if page_no is None:
            return _document("feed", path, body, candidate_ord=order)
        return _document("feed", F.concat(F.lit(f"{path}?paged="), page_no.cast("string")), body, candidate_ord=order, page_no=page_no)

    return _as_docs(
        listed,
        [
            [feed("/feed/", as_rss(rss), 1)],
            [
                feed("/feed/", as_rss(F.lit("")), 1),
                feed("/rss", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom">'), atom, F.lit("</feed>")), 2),
            ],
            [feed("/rss.xml", as_rss(guid), 3)],
        ],
    )


def probe_docs(pages: DataFrame) -> DataFrame:
    """Answers to the REST probes. The host's name length picks found, found, found, found or refused."""
    index = F.lit('{"name":"n","routes":{"/wp/v2":{}},"namespaces":["wp/v2"]}')
    spaces = F.lit('{"namespaces":["wp/v2"]}')
    gate = F.concat(F.lit("<html>Just a moment, "), F.col("host"), F.lit("</html>"))
    json_type = "application/json"
    first, second = "/wp-json/", "/?rest_route=/"

    def probe(path: str, body: Column, order: int, status: int = 200, kind: str = json_type) -> Column:
        return _document("rest_probe", path, body, candidate_ord=order, status=status, content_type=kind)

    return _as_docs(
        pages.select("site", "host").distinct(),
        [
            [probe(first, index, 1)],
            [probe(first, gate, 1, kind="text/html"), probe(second, spaces, 2)],
            [probe(first, F.lit("[]"), 1), probe(second, index, 2, kind="application/json; charset=utf-8")],
            [probe(first, F.lit("{}"), 1, status=404), probe(second, index, 2)],
            [
                probe(first, gate, 1, kind="text/html"),
                probe(second, F.concat(F.lit("no captcha, "), F.col("host")), 2, status=403),
            ],
            [probe(first, F.lit('{"code":1}'), 1, status=401), probe(second, index, 2)],
            [probe(first, F.lit('{"code":1}'), 1), probe(second, gate, 2, kind="text/html")],
        ],
    )


def listing_docs(pages: DataFrame) -> DataFrame:
    """REST listings of three items a page: English pages as pages, the others as posts.

    By the host's name length: closed by an empty page; announcing two pages; refused at page three;
    answering page two with HTML.
    """
    shape = F.col("shape")
    item = F.to_json(
        F.struct(
            F.col("url").alias("link"),
            F.when(shape == "html", F.lit("attachment")).otherwise(F.lit("page")).alias("type"),
            (shape == "slash").alias("protected"),
            F.struct(F.when(shape == "anchor", F.lit(" ")).otherwise(H.html_title_regex(F.col("html"))).alias("rendered")).alias("title"),
            F.struct(F.when(~shape.isin("feed", "paged"), F.col("html")).alias("rendered")).alias("content"),
            F.struct(F.when(shape == "feed", H.html_title_regex(F.col("html"))).alias("rendered")).alias("excerpt"),
            F.struct(F.concat(F.lit("café <q> & "), F.col("host")).alias("og_description")).alias("yoast_head_json"),
            F.when(shape == "plain", F.lit("2026-02-01T10:00:00")).otherwise(F.lit("soon")).alias("modified"),
        )
    )
    collection = F.when(F.contains(F.col("url"), F.lit("/en/")), F.lit("rest_pages")).otherwise(F.lit("rest_posts"))
    # Places are found on ids alone; the items then meet in groups of one listing page.
    group = ["site", "host", "kind"]
    items = pages.select("site", "host", collection.alias("kind"), "page_id", item.alias("item"))
    ids = pages.select("site", "host", collection.alias("kind"), "page_id")
    ranked = ordered_rank(ids, group, [F.col("page_id")], "place")
    places = ranked.withColumn("page_no", F.ceil(F.col("place") / LISTING).cast("int")).drop("place")
    last = places.groupBy(*group).agg(F.max("page_no").alias("last"))
    filled = (
        items.join(places, [*group, "page_id"])
        .groupBy(*group, "page_no")
        .agg(F.array_sort(F.collect_list(F.struct("page_id", "item"))).alias("entries"))
        .select(*group, "page_no", F.array_join(F.transform("entries", lambda e: e["item"]), ",").alias("list"))
    )
    turn = F.length("host") % 4
    closing = last.filter(turn == 0).select(*group, (F.col("last") + 1).alias("page_no"), F.lit("").alias("list"))
    return filled.unionByName(closing).select(
        "site",
        "kind",
        F.concat(F.lit("https://"), "host", F.lit("/wp-json/wp/v2/"), "kind", F.lit("?page="), F.col("page_no").cast("string")).alias("doc_url"),
        F.lit(None).cast("int").alias("candidate_ord"),
        "page_no",
        F.when(turn == 1, F.lit(2)).alias("total_pages"),
        F.when((turn == 2) & (F.col("page_no") == 3), F.lit(403)).otherwise(F.lit(200)).alias("status"),
        F.when((turn == 3) & (F.col("page_no") == 2), F.lit("text/html")).otherwise(F.lit("application/json")).alias("content_type"),
        F.concat(F.lit("["), "list", F.lit("]")).alias("body"),
    )


def site_docs(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    docs = sitemap_docs(blocks)
    for more in (feed_docs(blocks), probe_docs(pages), listing_docs(pages)):
        docs = docs.unionByName(more)
    return docs


def captures(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Imperfect captures of all pages, a page per block that links them, and a home page per site that links those.

    By shape of the URL the plain response holds a challenge, is thin, is an error, or is the page. Hosts
    not starting with ``www.`` have rendered captures too, which on ``m.`` hosts still show a challenge.
    """
    shape, html = F.col("shape"), F.col("html")
    signatures = F.array(*[F.lit(pattern) for pattern, _ in H.CHALLENGE_SIGNATURES])
    challenge = F.concat(
        F.lit("<html><p>"), F.get(signatures, (F.col("page_id") % len(H.CHALLENGE_SIGNATURES)).cast("int")), F.lit("</p>"), html
    )
    body = (
        F.when(shape == "html", challenge)
        .when(shape == "anchor", F.concat(F.lit('<html><title>Gate</title><a href="/x">'), F.col("host"), F.lit("</a></html>")))
        .when(shape == "feed", F.concat(F.lit('{"error":"'), F.col("url"), F.lit('"}')))
        .otherwise(html)
    )
    status = F.when(shape == "feed", F.lit(500)).when(shape == "slash", F.lit(404)).otherwise(F.lit(200))
    kind = F.when(shape == "feed", F.lit("application/json")).when(shape == "paged", F.lit("application/xhtml+xml")).otherwise(F.lit("text/html"))
    moment = F.lit("2024-01-01 00:00:00").cast("timestamp")
    mobile = F.col("host").startswith("m.")

    def row(capture_id: Column, url: Column, status: Column, kind: Column, body: Column, channel: str) -> list[Column]:
        return [
            capture_id.alias("capture_id"),
            F.col("site"),
            url.alias("url"),
            status.cast("int").alias("status"),
            kind.alias("content_type"),
            body.alias("body"),
            moment.alias("fetched_at"),
            F.lit(channel).alias("channel"),
            F.lit(1).alias("attempt"),
        ]

    page_id, ok, is_html = F.col("page_id"), F.lit(200), F.lit("text/html")
    plain = pages.select(*row(page_id, F.col("url"), status, kind, body, PRIMARY))
    rendered_body = F.when(mobile, F.concat(F.lit("<p>Just a moment</p>"), html)).otherwise(html)
    rendered = pages.filter(~F.col("host").startswith("www.")).select(
        *row(page_id + RENDERED_IDS, F.col("url"), ok, is_html, rendered_body, RENDERED)
    )

    def listing(title: Column, items: Column) -> Column:
        head, tail = F.lit("</title><main><ul>"), F.lit("</ul></main></html>")
        return F.concat(F.lit("<html><title>"), title, F.lit(" of "), F.col("host"), head, F.array_join(items, ""), tail)

    def address(block: Column) -> Column:
        return F.concat(_root(), F.lit("part/"), block.cast("string"))

    links = F.transform("entries", lambda e: F.concat(F.lit('<li><a href="'), _xml(e["url"]), F.lit('">page</a>')))
    parts = F.transform("heads", lambda h: F.concat(F.lit('<li><a href="'), address(h["block"]), F.lit('">part</a>')))
    home_body = listing(F.lit("Home"), parts)
    part_body = listing(F.concat(F.lit("Part "), F.col("block").cast("string")), links)
    part_id = -1 - F.get("entries", F.lit(0))["page_id"] - 2 * RENDERED_IDS
    part = blocks.select(*row(part_id, address(F.col("block")), ok, is_html, part_body, PRIMARY))
    blocked = F.when(mobile, F.concat(F.lit("<!-- cf-challenge -->"), home_body)).otherwise(home_body)
    homes = _heads(blocks).withColumn("first", F.get("heads", F.lit(0))["first"]["page_id"])
    home = homes.select(*row(-1 - F.col("first"), _root(), ok, is_html, blocked, PRIMARY))
    home_rendered = homes.select(*row(-1 - F.col("first") - RENDERED_IDS, _root(), ok, is_html, home_body, RENDERED))
    return plain.unionByName(rendered).unionByName(part).unionByName(home).unionByName(home_rendered)


def tree_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as three sites, with their budgets and depths, whose pages link four children each, the home page, and
    what they linked before."""
    place = F.floor(F.col("page_id") / len(TREES))
    tree = (F.col("page_id") % len(TREES)).cast("int")
    host = F.concat(F.lit("https://s"), tree.cast("string"), F.lit(".example.com"))
    children = F.array_join(
        F.transform(
            F.array(*[F.lit(j) for j in (1, 2, 3, 4)]),
            lambda j: F.concat(
                F.when(j % 2 == 0, F.lit('<a href="/P/')).otherwise(F.lit('<a href="/p/')),
                (place * 4 + j).cast("string"),
                F.lit('#c">child</a>'),
            ),
        ),
        "",
    )
    return read(spark, sf_dir, "pages").select(
        F.regexp_extract(host, "https://(.*)", 1).alias("site"),
        F.concat(host, F.when(place == 0, F.lit("/")).otherwise(F.concat(F.lit("/p/"), place.cast("string")))).alias("url"),
        F.concat("html", F.lit('<a href="/">home</a>'), children).alias("html"),
        F.get(F.array(*[F.lit(pages) for pages, _ in TREES]), tree).alias("max_pages"),
        F.get(F.array(*[F.lit(depth) for _, depth in TREES]), tree).alias("max_depth"),
    )


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages whose markdown is their text, one site per source."""
    text = F.col("text")
    return read(spark, sf_dir, "documents").select(
        F.col("source").alias("site"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.substring_index(text, "\n", 1).alias("title"),
        text.alias("markdown"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")).alias("fetched_at"),
        F.col("doc_id").alias("rank"),
        "lang",
    )
