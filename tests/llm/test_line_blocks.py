import html
import re

import numpy as np
import pytest

from corpusloom.llm.line_blocks import extract_main_text, main_text, text_stretches

SF_DIR = "/root/testdata/sf0.001"
LONG = "Some sentence that goes on for long enough to be taken for the text of the page."


def article(page):
    """The text of a page's article element, by the marks that the given pages use."""
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:h1|p|br)[^>]*>", inner[1] if inner else "")
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split()) for part in parts]
    return "\n".join(line for line in lines if line)


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    want = {r.page_id: (r.url, article(r.html), len(article(r.html))) for r in pages.collect()}
    assert {r[0]: tuple(r[1:]) for r in extract_main_text(pages).collect()} == want


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p> \n</p><!-- x", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>{LONG}<p>{LONG}<div>Imprint</div>", f"{LONG}\n{LONG}\nImprint"),
        (f"<div class=menu><p>{LONG}</div><main><h2>T</h2><p>a<br>b</main><div id='comments'><p>{LONG}</div>", "T\na\nb"),
        (f"<header>{LONG}</header><article><header><h1>T</h1></header><p>x</p></article><aside>{LONG}</aside>", "T\nx"),
        (f"<div role=navigation>{LONG}</div><p>{LONG}</p><form><p>{LONG}</form>", LONG),
        (f"<script>if (a < b) '<p>{LONG}'</script><style>p</style><p>{LONG} <b>x\n y</b>&nbsp;&#x41;</p>", f"{LONG} x y A"),
        (f"<p title='a > b'>{LONG}</p><![CDATA[x]]><svg><p>no</svg>", LONG),
        (f"<p>{LONG}", LONG),
        ("<p>a &lt;b&gt; c</p>", "a <b> c"),
        ("<nav>" * 3000 + "x" + "</nav>" * 3000 + f"<p>{LONG}</p>" * 3, "\n".join([LONG] * 3)),
        (f"<div class='article-header-image'><p>{LONG}</div>", LONG),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_surges_and_dives():
    lengths = np.array([2, 3, 0, 0, 0, 0, 0, 90, 100, 5, 120, 0, 0, 0, 0, 0, 0, 0, 0, 0, 4, 0, 0, 0, 0, 0, 100])
    assert text_stretches(lengths) == [(4, 14), (23, 27)]


def test_repeated_missing_and_no_rows(spark):
    rows = [(1, "u", f"<p>{LONG}", "x"), (1, "u", f"<p>{LONG}", "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract_main_text(pages).collect()), key=str) == [(1, "u", LONG, len(LONG))] * 2 + [(None, None, "", 0)]
    assert extract_main_text(pages.limit(0)).count() == 0


def test_long_pages():
    assert main_text("<div>" + f"<p>{LONG}</p>" * 20_000).count("\n") == 19_999


ROWS = [f"r{k}" for k in range(30)]
TABLE = "<table>" + "".join(f"<tr><td>{r}</td></tr>" for r in ROWS) + "</table>"
LINKS = "<ul>" + "".join(f"<li><a href=x>{r}</a></li>" for r in ROWS) + "</ul>"


@pytest.mark.parametrize("middle", [TABLE, LINKS])
def test_lists_in_the_middle_do_not_split_an_article(middle):
    page = f"<div><h1>T</h1><p>{LONG}</p>{middle}<p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(page).split("\n") == ["T", LONG, *ROWS, LONG, LONG]


def test_all_stretches_are_kept():
    assert main_text(f"<div><p>{LONG}</div><div>{LINKS}</div><div><p>{LONG}<p>{LONG}</div>") == "\n".join([LONG] * 3)
    assert main_text(f"<article><p>a</article><div>{LINKS}</div><article><p>b<p>c</article>") == "a\nb\nc"


@pytest.mark.parametrize("names", ["wrap has-sidebar", "no-sidebar", "with-header", "comments-open", "elementor-widget", "content-sidebar-wrap"])
def test_layout_around_the_article_is_no_aside(names):
    inside = f"<p>{LONG}</p><div class=sidebar><p>{LONG}</div>"
    for tag in ("article", "main"):
        assert main_text(f"<div class='{names}'><div id=site-header><{tag}>{inside}</{tag}></div></div>") == LONG


@pytest.mark.parametrize("names", ["wrap has-sidebar", "no-sidebar", "with-header", "comments-open", "elementor-widget", "page-header"])
def test_states_are_no_asides(names):
    assert main_text(f"<div class='{names}'><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</div>") == LONG


def test_headings_inside_and_articles_in_comments():
    for names in ("entry-header", "page-header"):
        assert main_text(f"<article><div class={names}><h1>T</h1></div><p>{LONG}</article>") == f"T\n{LONG}"
    page = f"<article><p>x</article><div id=comments><article><p>{LONG}</article></div>"
    assert main_text(page) == "x"
    assert main_text(f"<article><p>x</article><div class='content-sidebar-wrap'><main><p>{LONG}</main></div>") == f"x\n{LONG}"


SIDE = f"<div class=sidebar><p>{LONG}</p></div><footer><p>{LONG}</p></footer>"


@pytest.mark.parametrize("tag", ["article", "main", "div"])
@pytest.mark.parametrize(
    "before", ["<form id=aspnetForm>", "<div class='social-science'>", "<div id='menu-item-recipe'>", "<div class=my-header-wrap>", "<nav><a href=x>Home</a>", "<aside>"]
)
def test_weak_evidence_is_judged_by_density(before, tag):
    name = before[1:].split()[0].split(">")[0]
    after = "" if name in ("nav", "aside") else f"</{name}>"
    page = f"<body>{before}<{tag}><p>{LONG}</p><p>{LONG}</p></{tag}>{SIDE}{after}<p>Imprint</p></body>"
    assert main_text(page).split("\n")[:2] == [LONG, LONG]
    assert main_text(page).count(LONG) == 2


def test_weak_evidence_beside_the_text():
    text = f"<p>{LONG}<p>{LONG}"
    for part in (f"<form><p>{LONG}</form>", f"<div class=social-science><p>{LONG}</div>", f"<div><nav><p>{LONG}</div>"):
        assert main_text(f"<div>{text}</div>{part}") == f"{LONG}\n{LONG}"
    assert main_text(f"<article><p>{LONG}</article><div class=comments>{text}{text}</div>") == LONG
    assert main_text(f"<div><p>{LONG}</div><div id=comments><article><p>short</article></div>") == LONG
    assert main_text(f"<div class=comments>{text}</div>") == ""


def test_formulas_are_text():
    assert main_text(f"<p>{LONG} <math><mi>x</mi><annotation>\\x</annotation></math> y") == f"{LONG} x y"


def test_stretches_against_brute_force():
    random = np.random.default_rng(5)
    for _ in range(200):
        lengths = random.integers(0, 60, random.integers(1, 60)) * (random.random() < 0.7)
        lengths[random.random(len(lengths)) < 0.6] = 0
        dense = [sum(lengths[max(k - 3, 0) : k + 4]) >= 80 for k in range(len(lengths))]
        for k in [k for k in range(len(lengths)) if not dense[k]]:  # short gaps between dense lines belong to the stretch
            left = next((k - j for j in range(k, -1, -1) if dense[j]), 99)
            right = next((j - k for j in range(k, len(lengths)) if dense[j]), 99)
            lengths_of_gap = left + right - 1
            dense[k] = "gap" if lengths_of_gap <= 2 else False
        inside = [bool(d) for d in dense]
        want = [k for k in range(len(lengths)) if inside[k]]
        assert [k for a, b in text_stretches(lengths) for k in range(a, b)] == want
