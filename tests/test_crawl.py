import random
from collections import deque

from helpers import page, sites
from pyspark.sql import functions as F

from corpusloom.operators.crawl import crawl_bfs
from corpusloom.operators.links import adjacency, scan_links
from corpusloom.options import BuildOptions
from corpusloom.session import materialize

PAGES = "site string, url string, html string"


def walk(spark, pages, roots, options=BuildOptions(), **columns):
    table = materialize(sites(spark, roots, options, **columns), "sites")
    edges = adjacency(spark.createDataFrame(pages, PAGES), table)
    got = {}
    for r in crawl_bfs(edges, table).orderBy("site", "ordinal").collect():
        got.setdefault(r.site, []).append((r.url, r.depth))
    return got


def test_levels_cycles_and_case(spark):
    pages = [
        ("s", "https://s.com/", page(links=["/a", "/B", "/a/", "https://o.com/", "mailto:x@y", "#t", "/missing"])),
        ("s", "https://s.com/a", page(links=["/", "c/../d", "/b"])),
        ("s", "https://s.com/b", page(links=["/e", "/A"])),
        ("s", "https://s.com/d", page(links=["/too/deep"])),
        ("t", "https://t.com/", page(links=["/only"])),
    ]
    got = walk(spark, pages, {"s": "https://s.com", "t": "https://t.com", "none": "https://none.com/x/"}, BuildOptions(max_depth=2))
    s = "https://s.com"
    assert got["s"] == [(f"{s}/", 0), (f"{s}/a", 1), (f"{s}/B", 1), (f"{s}/missing", 1), (f"{s}/d", 2), (f"{s}/e", 2)]
    assert got["t"] == [("https://t.com/", 0), ("https://t.com/only", 1)]
    assert got["none"] == [("https://none.com/x", 0)]


def test_per_site_limits_and_root_patterns(spark):
    links = [f"/{i}" for i in range(9)]
    pages = [(s, f"https://{s}.com/", page(links=links)) for s in "abc"] + [("b", "https://b.com/0", page(links=["/x"]))]
    roots = {s: f"https://{s}.com" for s in "abc"}
    got = walk(spark, pages, roots, max_pages={"a": 3}, max_depth={"b": 1}, exclude={"c": ["c.com"]})
    assert [u for u, _ in got["a"]] == ["https://a.com/", "https://a.com/0", "https://a.com/1"]
    assert len(got["b"]) == 10 and "c" not in got


def queue_walk(graph, root, max_pages, max_depth):
    """The same walk with a queue, one page at a time."""
    seen, queue, out = {root.lower()}, deque([(root, 0)]), []
    while queue and len(out) < max_pages:
        url, depth = queue.popleft()
        out.append((url, depth))
        if depth >= max_depth:
            continue
        for link in dict.fromkeys(graph.get(url.lower(), [])):
            if len(out) + len(queue) >= max_pages:
                break
            if link.lower() not in seen:
                seen.add(link.lower())
                queue.append((link, depth + 1))
    return out


def test_random_graphs_match_a_queue(spark):
    rng = random.Random(7)
    graphs, pages, limits, depths = {}, [], {}, {}
    for n in range(40):
        site, size = f"g{n}", rng.randint(1, 25)
        root = f"https://{site}.com/"
        names = [root] + [f"{root}{'Pp'[rng.random() < 0.3]}{i}" for i in range(1, size)]
        graph = {}
        for name in names:
            links = [rng.choice(names) for _ in range(rng.randint(0, 6))]
            links = [x if rng.random() < 0.8 or x == root else x.replace(".com/P", ".com/p") for x in links]
            graph.setdefault(name.lower(), links)
        graphs[site] = graph
        pages += [(site, name, page(links=graph[name.lower()])) for name in {n.lower(): n for n in reversed(names)}.values()]
        limits[site], depths[site] = rng.randint(1, 20), rng.randint(1, 4)
    roots = {s: f"https://{s}.com/" for s in graphs}
    got = walk(spark, pages, roots, BuildOptions(max_pages=15, max_depth=9), max_pages=limits, max_depth=depths)
    for site, graph in graphs.items():
        assert got[site] == queue_walk(graph, roots[site], limits[site], depths[site]), site


def test_walk_does_not_depend_on_partitioning(spark, monkeypatch):
    import corpusloom.operators.crawl as crawl

    pages = [("s", f"https://s.com/{i or ''}", page(links=[f"/{j % 40}" for j in (3 * i, 5 * i + 1, 7 * i + 2)])) for i in range(40)]
    expected = walk(spark, pages, {"s": "https://s.com"}, BuildOptions(max_pages=25, max_depth=5))
    monkeypatch.setattr(crawl, "BROADCAST_ROWS", 0)
    assert walk(spark, pages[::-1], {"s": "https://s.com"}, BuildOptions(max_pages=25, max_depth=5)) == expected


def test_scan_links_and_salted_sites(spark, monkeypatch):
    import corpusloom.sources.tables as tables

    pages = spark.createDataFrame([("s", "https://s.com/a", page(links=["/b", "c", "https://o.com/x"]))], PAGES)
    table = materialize(sites(spark, {"s": "https://s.com"}), "sites")
    want = [("https://s.com/b", 0), ("https://s.com/c", 1)]
    assert [(r.link, r.link_ord) for r in scan_links(pages, table).orderBy("link_ord").collect()] == want
    monkeypatch.setattr(tables, "is_small", lambda df: False)
    assert [(r.link, r.link_ord) for r in scan_links(pages, table).orderBy("link_ord").collect()] == want


def test_links_are_taken_once_and_unshuffled(spark):
    table = materialize(sites(spark, {"s": "https://s.com"}), "sites")
    pages = spark.createDataFrame([("s", "https://s.com/a", "x")], PAGES)
    plan = adjacency(pages, table).filter(F.col("src_key") > "a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?i)<a(?=") == 1 and "Exchange hashpartitioning" not in plan
