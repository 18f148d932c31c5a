import json

from helpers import captures, docs, page, sites
from pyspark.sql import functions as F

from corpusloom.operators.merge import distinct_by_url, dry_run_list, merge_strategies
from corpusloom.options import BuildOptions
from corpusloom.plans.discover import discover_composite
from corpusloom.session import materialize
from corpusloom.sources.channels import effective_docs
from corpusloom.sources.feeds import scan_feeds
from corpusloom.sources.rest import rest_detect, scan_rest_items
from corpusloom.sources.sitemaps import scan_sitemaps

ROOT = {"s": "https://s.com/"}


def ordered(found):
    return [r.url for r in found.orderBy("site", "ordinal").collect()]


def urlset(*urls, tag=""):
    rows = "".join(f"<{tag}url><{tag}loc>{u}</{tag}loc><{tag}lastmod>x</{tag}lastmod></{tag}url>" for u in urls)
    space = f' xmlns:{tag[:-1]}="http://x"' if tag else ' xmlns="http://x"'
    return f'<?xml version="1.0" encoding="UTF-8"?><{tag}urlset{space}>{rows}</{tag}urlset>'


def index(*urls):
    return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"


def sitemap(ord, body, url=None, **more):
    return {"kind": "sitemap", "ord": ord, "doc_url": url or f"https://s.com/{ord}", "body": body, **more}


def scan(spark, rows, scanner=scan_sitemaps, options=BuildOptions(), **columns):
    return ordered(scanner(docs(spark, rows), materialize(sites(spark, ROOT, options, **columns), "sites"), options))


def scan_each(spark, cases, scanner=scan_sitemaps):
    """The URLs of many cases at once, each as a site of its own."""
    rows = [{**row, "site": f"s{i}"} for i, case in enumerate(cases) for row in case]
    table = materialize(sites(spark, {f"s{i}": ROOT["s"] for i in range(len(cases))}), "sites")
    got = {}
    for r in scanner(docs(spark, rows), table, BuildOptions()).orderBy("site", "ordinal").collect():
        got.setdefault(r.site, []).append(r.url)
    return [got.get(f"s{i}", []) for i in range(len(cases))]


def test_urlset_order_and_filters(spark):
    body = urlset("https://s.com/b/", "https://s.com/a?utm_x=1", " https://S.com/b#x ", "https://o.com/", "/rel", "ftp://s.com/", " ", "https://s.com/B", "https://s.com/c?x=1&amp;y=2")
    assert scan(spark, [sitemap(1, body)]) == ["https://s.com/b", "https://s.com/a", "https://s.com/B", "https://s.com/c?x=1&y=2"]
    assert "https://o.com/" in scan(spark, [sitemap(1, body)], same_host_only={"s": False})


def test_candidates_fall_through(spark):
    good = urlset("https://s.com/good", tag="sm:")
    bad = ("<urlset><url>", "", "<urlset/>", urlset("https://o.com/"), "not xml", index("::nope", "https://s.com/sub"))
    cases = [[sitemap(1, body), sitemap(3, good)] for body in bad]
    cases.append([sitemap(1, urlset("https://s.com/x"), status=404), sitemap(2, good)])
    cases.append([sitemap(2, good), sitemap(1, urlset("https://s.com/first"))])
    assert scan_each(spark, cases) == [["https://s.com/good"]] * 7 + [["https://s.com/first"]]


def test_index_reads_one_level_in_order(spark):
    rows = [
        sitemap(1, index("https://s.com/two.xml", "https://s.com/missing.xml", "https://s.com/bad.xml", "https://s.com/nested.xml", "https://s.com/one.xml")),
        sitemap(2, urlset("https://s.com/unused")),
        sitemap(None, urlset("https://s.com/1", "https://s.com/2"), "https://s.com/one.xml"),
        sitemap(None, urlset("https://s.com/2", "https://s.com/3"), "https://s.com/two.xml"),
        sitemap(None, "<urlset><url><loc>", "https://s.com/bad.xml"),
        sitemap(None, index("https://s.com/one.xml"), "https://s.com/nested.xml"),
    ]
    assert scan(spark, rows) == ["https://s.com/2", "https://s.com/3", "https://s.com/1"]


def test_empty_index_still_wins(spark):
    assert scan(spark, [sitemap(1, index("https://s.com/missing.xml")), sitemap(2, urlset("https://s.com/x"))]) == []


def test_sitemap_budget(spark):
    body = urlset(*[f"https://s.com/{i}" for i in range(50)])
    assert scan(spark, [sitemap(1, body)], options=BuildOptions(max_pages=7)) == [f"https://s.com/{i}" for i in range(7)]
    assert len(scan(spark, [sitemap(1, body)], max_pages={"s": 3})) == 3
    assert len(scan(spark, [sitemap(1, body)], options=BuildOptions(max_pages=2), max_pages={"s": 9})) == 9


def feed(ord, body, **more):
    return {"kind": "feed", "ord": ord, "body": body, **more}


def rss(items):
    return f'<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><link>https://s.com/self</link>{items}</channel></rss>'


def test_rss_links(spark):
    items = (
        "<item><link>https://s.com/1/</link><guid>https://s.com/no</guid></item>"
        '<item><atom:link href="x"/><link>https://s.com/2</link></item>'
        "<item><guid>https://s.com/3</guid></item>"
        '<item><guid isPermaLink="false">17</guid></item>'
        "<item><title>none</title></item><item><link>https://o.com/</link></item><item><link>https://s.com/1</link></item>"
    )
    assert scan(spark, [feed(1, rss(items))], scan_feeds) == ["https://s.com/1", "https://s.com/2", "https://s.com/3"]


def test_atom_takes_the_first_link(spark):
    body = '<feed xmlns="http://www.w3.org/2005/Atom"><link href="https://s.com/f"/><entry><link rel="self" href="https://s.com/a"/><link href="https://s.com/b"/></entry><entry/></feed>'
    assert scan(spark, [feed(1, body)], scan_feeds) == ["https://s.com/a"]


def test_feed_candidates(spark):
    good = rss("<item><link>https://s.com/good</link></item>")
    relative = rss("<item><link>https://s.com/x</link></item><item><link>/rel</link></item>")
    bad = (rss(""), "<bad", relative, rss("<item><link>https://o.com/</link></item>"))
    assert scan_each(spark, [[feed(1, body), feed(4, good)] for body in bad], scan_feeds) == [["https://s.com/good"]] * 4


def test_feed_of_several_pages_is_read_whole_and_in_order(spark):
    def paged(ord, no, *names):
        return feed(ord, rss("".join(f"<item><link>https://s.com/{n}</link></item>" for n in names)), page_no=no)

    relative = feed(2, rss("<item><link>/rel</link></item>"), page_no=2)
    rows = [paged(1, 1), paged(2, 10, "d", "a"), paged(2, 3, "b", "c"), relative, paged(2, 1, "a"), paged(3, 1, "later")]
    assert scan(spark, rows, scan_feeds) == [f"https://s.com/{n}" for n in "abcd"]
    assert scan(spark, rows, scan_feeds, max_pages={"s": 2}) == ["https://s.com/a", "https://s.com/b"]


INDEX = json.dumps({"name": "Example", "routes": {"/wp/v2": {}}, "namespaces": ["wp/v2"]})


def probe(ord, body, **more):
    return {"kind": "rest_probe", "ord": ord, "doc_url": f"https://s.com/p{ord}", "body": body, **more}


def item(link, **more):
    base = {"link": link, "title": {"rendered": "T"}, "content": {"rendered": "<p>c</p>"}, "modified": "2026-02-01T10:00:00"}
    return {**base, **more}


def listing(kind, page_no, items, **more):
    return {"kind": f"rest_{kind}", "page_no": page_no, "body": items if isinstance(items, str) else json.dumps(items), **more}


def test_rest_detection(spark):
    html = {"content_type": "text/html"}
    gate = "WP REST blocked by site protection: Cloudflare JS challenge"
    cases = [
        ([probe(1, INDEX)], (True, None, False)),
        ([probe(1, '{"namespace":null}')], (True, None, False)),
        ([probe(1, "{}"), probe(2, INDEX)], (True, None, False)),
        ([probe(1, "just a moment", **html), probe(2, INDEX)], (True, None, False)),
        ([probe(1, "just a moment", **html), probe(2, "[]")], (False, gate, True)),
        ([probe(1, INDEX, status=500), probe(2, "{bad")], (False, "WP REST route not detected", False)),
        ([probe(1, "x", status=401), probe(2, INDEX)], (False, "HTTP 401 from https://s.com/p1", False)),
        ([probe(1, "captcha", status=403)], (False, "Generic CAPTCHA", True)),
        ([probe(1, "just a moment", **html), probe(2, "captcha", status=403)], (False, "Cloudflare JS challenge", True)),
        ([probe(1, "x", status=403), probe(2, "captcha", **html)], (False, "HTTP 403 from https://s.com/p1", False)),
        ([{"kind": "feed", "body": ""}], (False, "WP REST route not detected", False)),
    ]
    rows = [{**row, "site": f"s{i}"} for i, (case, _) in enumerate(cases) for row in case]
    table = sites(spark, {f"s{i}": ROOT["s"] for i in range(len(cases))})
    got = {r.site: (r.available, r.reason, r.blocked_by_challenge) for r in rest_detect(docs(spark, rows), table).collect()}
    assert [got[f"s{i}"] for i in range(len(cases))] == [want for _, want in cases]


def rest(spark, rows, options=BuildOptions(as_of="2024-01-01 00:00:00")):
    found = scan_rest_items(docs(spark, [probe(1, INDEX), *rows]), sites(spark, ROOT, options), options)
    status = found.status.first()
    return ordered(found.items), (status.pages_count, status.posts_count, status.disabled), found


def rest_each(spark, cases, options=BuildOptions()):
    """URL paths and status of many cases at once, each as a site of its own."""
    rows = [{**row, "site": f"s{i}"} for i, case in enumerate(cases) for row in [probe(1, INDEX), *case]]
    table = materialize(sites(spark, {f"s{i}": ROOT["s"] for i in range(len(cases))}, options), "sites")
    found = scan_rest_items(docs(spark, rows), table, options)
    urls = {}
    for r in found.items.orderBy("site", "ordinal").collect():
        urls.setdefault(r.site, []).append(int(r.url.rsplit("/", 1)[1]))
    status = {r.site: (r.pages_count, r.posts_count, r.disabled) for r in found.status.collect()}
    return [(urls.get(f"s{i}", []), status[f"s{i}"]) for i in range(len(cases))]


def test_rest_harness_payload(spark):
    about = item("https://s.com/about/", title={"rendered": "About"}, content={"rendered": "<p>About content.</p>"})
    hello = item("https://s.com/hello-world/", title={"rendered": "Hello World"}, modified="2026-02-02T10:00:00")
    rows = [listing("pages", 1, [about], total_pages=1), listing("posts", 1, [hello], total_pages=1)]
    urls, status, found = rest(spark, rows, BuildOptions(max_pages=5))
    assert urls == ["https://s.com/about", "https://s.com/hello-world"] and status == (1, 1, False)
    got = found.items.orderBy("ordinal").select("title", "html", F.unix_seconds("modified_at").alias("m")).collect()
    assert [tuple(r) for r in got] == [("About", "<p>About content.</p>", 1769940000), ("Hello World", "<p>c</p>", 1770026400)]
    assert {r.discovery_method for r in found.discovered.collect()} == {"wordpress-rest"}


def test_rest_item_rules(spark):
    items = [
        item("https://s.com/file", type="Attachment"),
        item("https://s.com/locked", protected=True),
        item("https://s.com/open", protected="true", type="page"),
        item(" "),
        {"title": {"rendered": "no link"}},
        "text",
        item("/relative"),
        item("https://o.com/other"),
        item("https://s.com/no-html", content={"rendered": " "}),
        item("https://s.com/from-excerpt", content={}, excerpt={"rendered": "<script>x</script>e"}, title={"rendered": " "}),
        item("https://s.com/from-description", content={"rendered": 5}, yoast_head_json={"og_description": "a & é"}, title="plain", modified="soon"),
        item("https://s.com/only-script", content={"rendered": "<style>x</style>"}),
    ]
    urls, _, found = rest(spark, [listing("pages", 1, items)])
    assert urls == ["https://s.com/open", "https://s.com/from-excerpt", "https://s.com/from-description", "https://s.com/only-script"]
    got = {r.url.rsplit("/", 1)[1]: r for r in found.items.withColumn("m", F.unix_seconds("modified_at")).collect()}
    assert (got["from-excerpt"].title, got["from-excerpt"].html) == ("from excerpt", "e")
    assert (got["from-description"].title, got["from-description"].html) == ("from description", "<p>a &amp; &#233;</p>")
    assert got["from-description"].m == 1704067200 and got["only-script"].html == ""


def numbered(a, b):
    return [item(f"https://s.com/{i}") for i in range(a, b)]


def test_rest_paging(spark):
    three = [listing("pages", 1, numbered(0, 2)), listing("pages", 2, numbered(2, 4)), listing("pages", 4, numbered(6, 8))]
    items = json.dumps(numbered(4, 6))
    bad = [{"body": "[]"}, {"body": "{}"}, {"body": "{bad"}, {"body": items, "status": 500}, {"body": items, "content_type": "text/html"}]
    cases = [three, *[[*three, {"kind": "rest_pages", "page_no": 3, **b}] for b in bad]]
    cases.append([listing("pages", 2, numbered(0, 2))])
    cases.append([listing("pages", i, numbered(i, i + 1), total_pages=2) for i in (1, 2, 3)])
    urls = [u for u, _ in rest_each(spark, cases)]
    assert urls == [[0, 1, 2, 3]] * 6 + [[], [1, 2]]


def test_rest_refusals(spark):
    pages, posts = listing("pages", 1, numbered(0, 2)), listing("posts", 1, numbered(2, 4))
    refused, done = {"status": 403}, listing("pages", 1, numbered(0, 2), total_pages=1)
    cases = [
        ([pages, posts], [0, 1, 2, 3], (2, 2, False)),
        ([pages, listing("pages", 2, "x", **refused), posts], [], (2, 0, True)),
        ([pages, posts, listing("posts", 2, "x", status=401)], [], (2, 2, True)),
        ([pages, posts, listing("posts", 3, "x", **refused)], [0, 1, 2, 3], (2, 2, False)),
        ([listing("pages", 1, "x", **refused), posts], [], (0, 0, True)),
        ([done, listing("pages", 2, "x", **refused), posts], [0, 1, 2, 3], (2, 2, False)),
    ]
    assert rest_each(spark, [rows for rows, _, _ in cases]) == [(urls, status) for _, urls, status in cases]
    full = [pages, listing("pages", 2, "x", **refused), posts]
    assert rest_each(spark, [full], BuildOptions(max_pages=2)) == [([0, 1], (2, 0, False))]


def test_rest_budget_is_shared(spark):
    rows = [listing("pages", 1, numbered(0, 3)), listing("posts", 1, numbered(2, 9)), listing("posts", 2, "x", status=403)]
    urls, status, _ = rest(spark, rows, BuildOptions(max_pages=5))
    assert status == (3, 2, False)
    assert urls == [f"https://s.com/{i}" for i in range(4)]


def found(spark, rows, method):
    schema = "site string, url string, ordinal bigint"
    return spark.createDataFrame(rows, schema).withColumns({"discovery_method": F.lit(method), "depth": F.lit(0)})


def test_merge_precedence_filter_and_budget(spark):
    first = found(spark, [("s", "https://s.com/A", 1), ("s", "https://s.com/skip", 2)], "one")
    second = found(spark, [("s", "https://s.com/a", 0), ("s", "https://s.com/b", 1), ("s", "https://s.com/c", 2), ("t", "https://t.com/", 0)], "two")
    options = BuildOptions(max_pages=2, exclude=("skip",))
    table = sites(spark, {"s": "https://s.com", "t": "https://t.com"}, options)
    merged = merge_strategies([first, second], table)
    got = [(r.site, r.url, r.discovery_method, r.rank) for r in merged.orderBy("site", "rank").collect()]
    assert got == [("s", "https://s.com/A", "one", 1), ("s", "https://s.com/b", "two", 2), ("t", "https://t.com/", "two", 1)]
    assert dry_run_list(merged, table).columns == ["site", "rank", "url"]


def test_distinct_is_case_sensitive(spark):
    rows = [("s", "u", 3), ("s", "U", 2), ("s", "u", 1), ("t", "u", 9)]
    got = distinct_by_url(found(spark, rows, "m")).collect()
    assert sorted((r.site, r.url, r.ordinal) for r in got) == [("s", "U", 2), ("s", "u", 1), ("t", "u", 9)]


def test_rendered_copies_stand_for_blocked_answers(spark):
    rows = [
        ("a", 503, "busy", "http"), ("a", 200, "good a", "rendered"), ("b", 200, "<html>Just a moment</html>", "http"), ("b", 200, "good b", "rendered"),
        ("c", 200, "plain c", "http"), ("c", 200, "other", "rendered"), ("d", 403, "no", "http"), ("d", 403, "no", "rendered"), ("e", 200, "alone", "rendered"),
    ]
    table = docs(spark, [{**sitemap(1, body), "doc_url": name, "status": status} for name, status, body, _ in rows])
    channels = spark.createDataFrame([(n, s, b, c) for n, s, b, c in rows], "doc_url string, status int, body string, channel string")
    table = table.join(channels, ["doc_url", "status", "body"])
    got = {(r.doc_url, r.body) for r in effective_docs(table).collect()}
    assert got == {("a", "good a"), ("b", "good b"), ("c", "plain c"), ("d", "no")}
    assert effective_docs(table.drop("channel")).count() == table.count()


def test_sub_sitemaps_are_found_by_their_canonical_address(spark):
    rows = [sitemap(1, index("https://S.com:443/sub.xml")), {**sitemap(None, urlset("https://s.com/x")), "doc_url": "https://s.com/sub.xml"}]
    assert scan(spark, rows) == ["https://s.com/x"]


def test_composite(spark):
    table = materialize(
        sites(spark, {"s": "https://s.com", "full": "https://full.com", "off": "https://off.com"}, max_pages={"full": 2}, exclude={"off": ["off.com"]}),
        "sites",
    )
    rows = [
        sitemap(1, urlset("https://s.com/m", "https://s.com/x")),
        feed(1, rss("<item><link>https://s.com/X</link></item><item><link>https://s.com/f</link></item>")),
        {**sitemap(1, urlset("https://full.com/1", "https://full.com/2", "https://full.com/3")), "site": "full"},
    ]
    pages = captures(
        spark,
        [
            (1, "s", "https://s.com/", page(links=["/c1", "/f", "/c2"])),
            (2, "s", "https://s.com/c1", page(links=["/deep"])),
            (3, "full", "https://full.com/", page(links=["/c"])),
            (4, "off", "https://off.com/", page(links=["/c"])),
        ],
    )
    discovery = discover_composite(table, pages, docs(spark, rows), BuildOptions())
    got = {}
    for r in discovery.urls.orderBy("site", "rank").collect():
        got.setdefault(r.site, []).append((r.url.split(".com")[1], r.discovery_method, r.depth))
    assert got["s"] == [
        ("/m", "sitemap", 0),
        ("/x", "sitemap", 0),
        ("/f", "rss", 0),
        ("/", "crawl", 0),
        ("/c1", "crawl", 1),
        ("/c2", "crawl", 1),
        ("/deep", "crawl", 2),
    ]
    assert got["full"] == [("/1", "sitemap", 0), ("/2", "sitemap", 0)]
    assert "off" not in got
