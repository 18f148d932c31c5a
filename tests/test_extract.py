import re

import pytest


from corpusloom.functions.markdown import main_markdown
from corpusloom.operators.extract import NO_CONTAINER, TOO_SHORT, extract_pages, skip_reason


def md(page):
    return re.sub(r"\n{3,}", "\n\n", main_markdown(page)).strip()


@pytest.mark.parametrize(
    "page, want",
    [
        ("<h1>T</h1><p>a <b>b</b> <i>c</i> <del>d</del> <code>e_f</code>", "# T\n\na **b** *c* ~~d~~ `e_f`"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("a<br>b<hr>c", "a\nb\n\n* * *\n\nc"),
        ("<a href='/x'>t</a><a>u</a><img src=i alt=j><img alt=none>", "[t](/x)u![j](i)"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
        ("<ol><li>a</li><li>b</li></ol>", "1. a\n2. b"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n> \n> b"),
        ("<pre><code>x = 1\n  y *z*</code></pre>", "```\nx = 1\n  y *z*\n```"),
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2|3</td></tr></table>", "| A | B |\n| --- | --- |\n| 1 | 2\\|3 |"),
        ("<p>2 * 3 _ 4", "2 \\* 3 \\_ 4"),
        ("<p>&lt;tag&gt; &amp; &eacute;&nbsp;x", "<tag> & é\u00a0x"),
        ("<unknown>kept</unknown>", "kept"),
        ("a<!-- no -->b<script>no</script>c<style>no</style>d", "abcd"),
        ("<nav>no</nav><header>no</header><footer>no</footer><aside>no</aside><noscript>no</noscript>yes", "yes"),
        ("<script>var t = '</p>'; if (a < b) {}</script>x", "x"),
        ("<p><b>one.<br><p>two</p><div>three</b> four</div>five", "**one.**\n\n**two**\n\n**three** four\n\nfive"),
        ("<b>a<b>b</b></b>", "**ab**"),
        ("<div title='a > b'>x</div>", "x"),
        ("5 < 6 and <3", "5 < 6 and <3"),
        ("x<p title=\"never closed>y", "x"),
        ("", ""),
    ],
)
def test_markdown(page, want):
    assert md(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<article>a</article><main>m</main>", "m"),
        ("<div role='main'>r</div><article>a1</article><article>a2</article>", "a1"),
        ("<div class='post-content'>c</div><div role=main>r</div>", "r"),
        ("x<div class='wide entry-content'>c</div>", "c"),
        ("<div class='contents'>x</div>y", "x\n\ny"),
        ("<aside><article>in</article></aside>out", "in"),
        ("<main><article>a</article>rest</main>", "a\n\nrest"),
        ("<main><nav>n</nav><div><footer>f</footer>k</div></main>", "k"),
        ("<article>open", "open"),
    ],
)
def test_container(page, want):
    assert md(page) == want


def test_frames_have_no_container():
    assert main_markdown("<frameset><frame src=x></frameset>") is None


def test_deep_nesting_and_unclosed_tags():
    assert md("<div>" * 20000 + "x" + "</div>" * 20000) == "x"
    assert md("<p><b>" * 2000 + "x").endswith("**x**")


def test_extract_pages(spark):
    long = "<main><p>" + "word " * 20 + "</p></main>"
    rows = [
        (1, long),
        (2, "<main>" + "x" * 49 + "</main>"),
        (3, "<main>" + "x" * 50 + "</main>"),
        (4, "<frameset>"),
        (5, None),
    ]
    got = {r.id: r for r in extract_pages(spark.createDataFrame(rows, "id int, html string")).collect()}
    assert got[1].outcome == "Success" and not got[1].is_skipped and got[1].markdown == ("word " * 20).strip()
    assert (got[2].outcome, got[2].skip_reason) == ("ExtractionSkipped", TOO_SHORT)
    assert got[3].outcome == "Success"
    assert (got[4].outcome, got[4].skip_reason, got[4].markdown) == ("ExtractionSkipped", NO_CONTAINER, None)
    assert got[5].outcome == "ExtractionSkipped"


def test_failures_become_rows(spark):
    def convert(page):
        if page == "bad":
            raise ValueError(page)
        return "fine " * 20

    rows = [(1, "bad"), (2, "good")]
    got = {r.id: r.outcome for r in extract_pages(spark.createDataFrame(rows, "id int, html string"), convert).collect()}
    assert got == {1: "FetchFailed", 2: "Success"}


def test_skip_rule(apply):
    assert apply(skip_reason, ["x" * 49, "x" * 50, None]) == [TOO_SHORT, None, NO_CONTAINER]


def test_extraction_reads_only_its_columns(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    plan = extract_pages(pages).select("page_id", "content_hash")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
