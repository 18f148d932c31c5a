import random

from corpusloom.llm.queries import URL_RULES
from corpusloom.llm.url_rules import judge_urls, rule_table


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
    path = tail[: min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    None, "", "no scheme.com/en/", "http://example.com", "http://EXAMPLE.com/", "https://www.Example.com/en/x", "https://a.www.example.com/en/?q=/fr/",
    "https://b.example.com/en/", "http://example.net/es/1", "http://example.net/fr", "http://example.net/fr/#a", "http://notexample.com/en/",
    "ftp://x.net?y=/es/", "http://com/", "http:///en/", "x://a.b://c.com/en/", "http://example.com/en/\nz", "http://é.net/es/", "http://.net/es/", "http://net./es/",
    "http://" + "a." * 40 + "net/fr/", "http://example.org/" + "p/" * 3000,
]


def pages(spark, urls, ids=None):
    rows = [(k if ids is None else ids[k], u, "h", "r", "x") for k, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, rule string, key string")


def test_rules_equal_brute_force(spark):
    rows = judge_urls(pages(spark, URLS + URLS[5:8]), rule_table(spark, URL_RULES)).collect()
    assert {r.page_id: tuple(r[1:]) for r in rows} == {k: brute(u, URL_RULES) for k, u in enumerate(URLS + URLS[5:8])}


def test_many_rules_false_positives_and_ties(spark):
    rng = random.Random(1)
    rules = [(f"h{k % 900}.com", "/" + "abc"[k % 3] * (k % 7), "block" if k % 2 else "allow") for k in range(3000)]
    rules += [("y.com", "/a/", "allow"), ("x.y.com", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("z.com", "/", "allow"), ("z.com", "/", "block")]
    urls = [f"http://{rng.choice(['', 'www.'])}h{rng.randrange(1100)}.com/{rng.choice('abc') * rng.randrange(8)}" for _ in range(3000)]
    urls += ["http://x.y.com/a/", "http://z.com/q"]
    got = {r.page_id: tuple(r[1:]) for r in judge_urls(pages(spark, urls), rule_table(spark, rules)).collect()}
    usable = [r for r in dict.fromkeys(rules) if r[0] and (r[2] == "block" or (r[0], r[1], "block") not in rules)]
    assert got == {k: brute(u, usable) for k, u in enumerate(urls)}


def test_no_rules_no_pages_no_ids(spark):
    none = rule_table(spark, URL_RULES).limit(0)
    assert [tuple(r) for r in judge_urls(pages(spark, ["http://a.com/b"], [None]), none).collect()] == [(None, "a.com", "/b", None, "allow")]
    assert judge_urls(pages(spark, URLS).limit(0), rule_table(spark, URL_RULES)).count() == 0


def test_plan_is_native(spark):
    plan = judge_urls(pages(spark, URLS), rule_table(spark, URL_RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
