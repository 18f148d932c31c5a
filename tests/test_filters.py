import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.url_filter import allowed_by_list, pattern_keys, url_allowed, url_allowed_by
from corpusloom.options import BuildOptions, split_patterns

URLS = [
    "https://h.x/products/a",
    "https://h.x/Docs/changelog",
    "https://h.x/docs/intro?tag=1",
    "https://h.x/a.b",
    "https://h.x/axb",
    "https://h.x/q?x=1",
]
RULES = [
    ((), (), [0, 1, 2, 3, 4, 5]),
    (("*/products/*",), (), [0]),
    (("*docs*",), ("*changelog*", "*tag*"), []),
    (("*docs*",), ("*changelog*",), [2]),
    (("DOCS",), (), [1, 2]),
    ((), ("a.b",), [0, 1, 2, 4, 5]),
    (("*a.b",), (), [3]),
    (("*?x=*",), (), [5]),
    (("products/*",), (), []),
    ((" ", ""), (), []),
    ((), (" ", "/docs"), [0, 3, 4, 5]),
    ((" *://h.x/a* ",), (), [3, 4]),
    (("*\\E*",), (), []),
]


@pytest.mark.parametrize("include, exclude, want", RULES)
def test_rules(apply, include, exclude, want):
    fixed = apply(lambda v: url_allowed(v, include, exclude), URLS)
    assert [i for i, ok in enumerate(fixed) if ok] == want

    def column(patterns):
        return F.array(*[F.lit(p) for p in patterns]).cast("array<string>")

    by_column = apply(lambda v: url_allowed_by(v, column(include), column(exclude)), URLS)
    assert by_column == fixed


def test_null_pattern_columns(apply):
    null = F.lit(None).cast("array<string>")
    assert apply(lambda v: url_allowed_by(v, null, null), URLS[:1]) == [True]


def test_options():
    assert split_patterns(" a, ,b ,") == ("a", "b")
    with pytest.raises(ValueError):
        BuildOptions(max_pages=0)
    with pytest.raises(ValueError):
        BuildOptions(max_depth=-1)


LISTED = [*URLS, "https://h.x/KK/ſo", "https://h.x/KK/SO", None]


@pytest.mark.parametrize("seed", [1, 2])
def test_listed_patterns_follow_the_rule_of_columns(spark, seed):
    """Random pattern lists of some sites, short ones, blank ones and others beyond ASCII among them."""
    draw = random.Random(seed)
    pool = [p for include, exclude, _ in RULES for p in (*include, *exclude)]
    pool += ["*", "x", "*o*", "K", "*/sÖ*", "kk/", "*KK*so", "q?x=1", "*h.x/*1", "\\E", "a.b*"]
    rules = {f"s{k}": [draw.sample(pool, draw.choice([0, 0, 1, 2, 6])) for _ in range(2)] for k in range(24)}
    rows = [(site, kind == 1, p) for site, lists in rules.items() for kind in (0, 1) for p in lists[kind]]
    listed = spark.createDataFrame(rows, "site string, is_exclude boolean, pattern string")
    pages = spark.createDataFrame([(s, u, i) for s in [*rules, "none"] for i, u in enumerate(LISTED)], "site string, url string, n int")
    lists = [(s, include, exclude) for s, (include, exclude) in rules.items()]
    columns = spark.createDataFrame(lists, "site string, include array<string>, exclude array<string>")
    given = pages.join(columns, "site", "left").filter("url IS NOT NULL").filter(url_allowed_by(F.col("url"), F.col("include"), F.col("exclude")))
    got = allowed_by_list(pages, listed)
    assert got.columns == pages.columns
    closed = {s for s, (include, _) in rules.items() if include}
    want = {(r.site, r.n) for r in given.collect()} | {(s, len(LISTED) - 1) for s in [*rules, "none"] if s not in closed}
    kept = [(r.site, r.n) for r in got.collect()]
    assert set(kept) == want and len(kept) == len(want)


def test_many_patterns_of_one_site(spark):
    """Ten thousand patterns; each URL meets few of them."""
    listed = spark.range(10_000).selectExpr("'h' site", "true is_exclude", "concat('*/docs/', id, '/old*') pattern")
    pages = spark.range(3_000).selectExpr("'h' site", "concat('https://h.x/docs/', id * 7, '/', if(id % 2 = 0, 'old', 'new')) url", "id")
    kept = {r.id for r in allowed_by_list(pages, listed).collect()}
    assert kept == {i for i in range(3_000) if i % 2 or i * 7 >= 10_000}
    crowd = pattern_keys(listed).groupBy("gram").count().agg(F.max("count")).first()[0]
    assert crowd <= 100
