from helpers import captures, page, sites

from corpusloom.operators.triage import (
    choose_captures,
    match_captures,
    filter_response,
    join_capture_fallback,
    protection_labels,
    protection_report,
    scan_captures,
)
from corpusloom.session import materialize

GOOD, GATE, THIN = page("Good"), page("Gate").replace("word", "captcha", 1), "<html>thin</html>"
RENDERED = {"channel": "rendered"}


def test_choose(spark):
    rows = [
        (1, "s", "https://s/ok", GOOD),
        (2, "s", "https://s/ok", GOOD, RENDERED),
        (3, "s", "https://s/gate", GATE),
        (4, "s", "https://s/gate", GOOD, RENDERED),
        (5, "s", "https://s/gate-only", GATE),
        (6, "s", "https://s/still", GATE),
        (7, "s", "https://s/still", GATE, RENDERED),
        (8, "s", "https://s/thin", THIN),
        (9, "s", "https://s/thin", GOOD, RENDERED),
        (10, "s", "https://s/rejected", "{}", {"content_type": "application/json"}),
        (11, "s", "https://s/rejected", GOOD, RENDERED),
        (12, "s", "https://s/lost", "{}", {"content_type": "application/json"}),
        (13, "s", "https://s/blank", GATE),
        (14, "s", "https://s/blank", "  ", RENDERED),
        (15, "s", "https://s/rendered-only", GOOD, RENDERED),
        (16, "s", "https://s/Case", GOOD),
        (17, "s", "https://S/case/#x", GOOD),
        (18, "s", "https://s/retry", "busy", {"status": 503, "attempt": 1}),
        (19, "s", "https://s/retry", GOOD, {"attempt": 2}),
    ]
    chosen = materialize(choose_captures(captures(spark, rows)), "test")
    got = {r.url: (r.capture_id, r.channel, r.fallback_reason, r.still_blocked) for r in chosen.collect()}
    assert got == {
        "https://s/ok": (1, "http", None, False),
        "https://s/gate": (4, "rendered", "challenge", False),
        "https://s/gate-only": (5, "http", "challenge", False),
        "https://s/still": (7, "rendered", "challenge", True),
        "https://s/thin": (9, "rendered", "thin", False),
        "https://s/rejected": (11, "rendered", "failed", False),
        "https://s/lost": (None, None, "failed", False),
        "https://s/blank": (13, "http", "challenge", False),
        "https://s/rendered-only": (15, "rendered", "failed", False),
        "https://s/Case": (16, "http", None, False),
        "https://s/case": (17, "http", None, False),
        "https://s/retry": (19, "http", None, False),
    }
    shells = join_capture_fallback(captures(spark, rows), chosen).collect()
    assert sorted(r.capture_id for r in shells) == sorted(v[0] for v in got.values() if v[0])
    assert {r.url for r in shells if r.capture_id == 16} == {"https://s/Case"}


def test_exact_url_counts_before_one_that_differs_in_case(spark):
    rows = [(1, "s", "https://s/Page", GOOD), (2, "s", "https://s/page", GOOD), (3, "s", "https://s/LOST", GOOD), (4, "s", "https://s/lost", " ")]
    chosen = choose_captures(captures(spark, rows))
    urls = [("s", f"https://s/{p}", f"https://s/{p.lower()}") for p in ("Page", "page", "PAGE", "lost", "none")]
    found = match_captures(spark.createDataFrame(urls, "site string, url string, url_key string"), chosen)
    got = {r.url.rsplit("/", 1)[1]: r.capture_id for r in found.collect()}
    assert got == {"Page": 1, "page": 2, "PAGE": 1, "lost": None, "none": None}


def test_join_beyond_the_broadcast_limit(spark, monkeypatch):
    import corpusloom.operators.triage as triage

    monkeypatch.setattr(triage, "broadcast_if_small", lambda ids: ids)
    table = captures(spark, [(i, "s", f"https://s/{i}", GOOD) for i in range(20)])
    shells = join_capture_fallback(table, materialize(choose_captures(table), "test"))
    assert shells.count() == 20
    assert "BroadcastHashJoin" not in shells._jdf.queryExecution().optimizedPlan().toString()


def test_gate(spark):
    rows = [
        (1, "s", "https://s/a", "<html>404 page</html>", {"status": 404}),
        (2, "s", "https://s/b", "nothing", {"status": 404}),
        (3, "s", "https://s/feed", "<rss/>", {"content_type": "application/rss+xml"}),
        (4, "s", "https://s/c", "{}", {"content_type": "application/json"}),
        (5, "s", "https://s/d", " "),
    ]
    assert sorted(r.capture_id for r in filter_response(captures(spark, rows)).collect()) == [1, 3]


def test_shells(spark):
    rows = [
        (1, "s", "https://s/my-page/", "<html><title> </title></html>"),
        (2, "s", "https://s/x", "<html><title></title></html>", RENDERED),
        (3, "s", "not a url", GOOD),
    ]
    assert {r.capture_id: (r.url, r.title) for r in scan_captures(captures(spark, rows)).collect()} == {
        1: ("https://s/my-page", "my page"),
        2: ("https://s/x", ""),
    }


def test_protection(spark):
    table = captures(
        spark,
        [
            (1, "a", "https://a/", "just a moment", {"status": 503}),
            (2, "b", "https://b", GOOD),
            (3, "b", "https://b/x", GATE),
            (4, "c", "https://c/", GATE, RENDERED),
        ],
    )
    labels = protection_labels(table, sites(spark, {"a": "https://a", "b": "https://b/", "c": "https://c"}))
    assert {r.site: r.label for r in labels.collect()} == {"a": "Cloudflare JS challenge", "b": None, "c": None}
    assert {r.label: r.sites for r in protection_report(labels).collect()} == {"Cloudflare JS challenge": 1, "none": 2}
