from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import jsonval as J


def test_looks_like_html(apply):
    values = ["<!DOCTYPE HTML>", "x<Head>", "<BODY>", "<html", "plain", "", None, " " * 4096 + "<html>", " " * 4091 + "<html"]
    assert apply(H.looks_like_html, values) == [True, True, True, True, False, False, False, False, True]


def test_every_signature_and_shadowing(apply):
    labels = apply(H.detect_challenge, [f"<p>{pattern.upper()}</p>" for pattern, _ in H.CHALLENGE_SIGNATURES])
    want = [label for _, label in H.CHALLENGE_SIGNATURES]
    want[1] = want[0]
    want[7] = want[8] = "Generic CAPTCHA"
    assert labels == want


def test_first_signature_wins_within_the_prefix(apply):
    values = ["captcha just a moment", "x" * 4096 + "captcha", "x" * 4089 + "captcha", "", None]
    assert apply(H.detect_challenge, values) == ["Cloudflare JS challenge", None, "Generic CAPTCHA", None, None]
    assert apply(H.is_challenge, values) == [True, False, True, False, False]


def test_thin(apply):
    assert apply(H.is_too_thin, ["x" * 599, "x" * 600, " " * 700, None]) == [True, False, True, True]


def test_accepts_response(spark):
    page, text = "<html>x</html>", "plain"
    cases = [
        (200, "text/html; charset=utf-8", text, True),
        (200, "application/xml", text, True),
        (200, "application/json", text, False),
        (200, None, page, True),
        (404, "text/html", text, False),
        (404, "text/html", page, True),
        (None, "text/html", page, True),
        (200, "TEXT/HTML", " \n", False),
        (200, "text/html", None, False),
    ]
    df = spark.createDataFrame(cases, "s int, c string, b string, want boolean")
    got = df.select(H.accepts_response(F.col("s"), F.col("c"), F.col("b")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_titles(apply):
    values = [
        "<title>A &amp; B</title>",
        "<TITLE lang=x>\n a\n  b </TITLE>",
        "<title></title>",
        "none",
        "<!-- <title>no</title> --><title>yes</title>",
        "<title>&eacute;&#233;&#xE9;&nope;&amp c</title>",
        "<title>one</title><title>two</title>",
        None,
    ]
    url = F.lit("https://h.x/some-page")
    assert apply(lambda v: H.html_title(v, url), values) == ["A & B", "a b", "some page", "some page", "yes", "ééé&nope;& c", "one", "some page"]
    assert apply(H.html_title_regex, values) == ["A & B", "a\n  b", "", None, "no", "ééé&nope;&amp c", "one", None]


def test_entities(apply):
    assert apply(lambda v: H.decode_entities(v, "text"), ["a&lt;b&gt", "&notit;", "&AMP;&hellip;", "&#0;&#xD800;", "&#128512;", "&&amp;"]) == [
        "a<b>",
        "¬it;",
        "&…",
        "&#0;&#xD800;",
        "😀",
        "&&",
    ]
    assert apply(lambda v: H.decode_entities(v, "attribute"), ["?a=1&copy=2", "?a=1&copy;", "x&lt"]) == ["?a=1&copy=2", "?a=1©", "x<"]


def test_numbers_with_leading_zeros(apply):
    assert apply(lambda v: H.decode_entities(v), ["&#x0000041;", "&#000000065;", "&#x00110000;", "&#00;"]) == ["A", "A", "&#x00110000;", "&#00;"]


def test_sanitize_and_encode(apply):
    assert apply(H.sanitize_html, ["a<SCRIPT x>\n1</script>b<style>c</STYLE>d<script>e", " ", None]) == ["abd<script>e", "", ""]
    assert apply(H.html_encode_paragraph, ["<a & \"b\" 'c'> é€"]) == ["<p>&lt;a &amp; &quot;b&quot; &#39;c&#39;&gt; &#233;€</p>"]
    assert apply(H.wrap_article, ["x"]) == ["<article>x</article>"]


LINKS = """
<!-- <a href="/comment"> --><script>document.write('<a href="/script">')</script>
<a href="/one">1</a><A title="x > y" HREF='two?x=1&amp;y=2'>2</A><a href=//o.com/three>3</a>
<a name="n">no</a><a data-href="/data">no</a><a href=" ">no</a><a href="#top">no</a><a href="mailto:a@b">no</a>
<a href="javascript:x()">no</a><a href="/one/">again</a><a href="../up/./four">4</a><link href="/css"><abbr href="/abbr">
<a class="q"href="/five">5</a>
"""


def test_page_links(apply):
    base, root = F.lit("https://s.com/d/e"), F.lit("https://s.com/")
    every = ["https://s.com/one", "https://s.com/d/two?x=1&y=2", "https://o.com/three", "https://s.com/up/four", "https://s.com/five"]
    assert apply(lambda v: H.page_links(v, base, root, F.lit(False)), [LINKS]) == [every]
    assert apply(lambda v: H.page_links(v, base, root, F.lit(True)), [LINKS, ""]) == [[u for u in every if "o.com" not in u], []]


def test_links_of_broken_markup(apply):
    base, root = F.lit("https://s.com/"), F.lit("https://s.com/")
    many = "<a " + 'x="y" ' * 20000 + 'href="/q">'
    values = ['<a href="/a">', '<a href="/b', "<a <a href='/c'>", many]
    got = apply(lambda v: H.page_links(v, base, root, F.lit(True)), values)
    quoted = ['<a title="see href=/wrong now" href="/right">', "<a data-x=' href=\"/no\" ' HREF = /yes>", '<a href title=x href="/late">']
    assert apply(lambda v: H.page_links(v, base, root, F.lit(True)), quoted) == [[f"https://s.com/{p}"] for p in ("right", "yes", "late")]
    assert got[0] == ["https://s.com/a"] and got[2] == ["https://s.com/c"] and got[3] == ["https://s.com/q"]


def test_json_values(spark):
    rows = [('{"a":{"b":" x "},"n":5,"t":true,"d":"2026-02-01T10:00:00","z":null}',), ('{"a":"b"}',), ("[1]",), ("{bad",)]
    v = F.try_parse_json("j")
    got = spark.createDataFrame(rows, "j string").select(
        J.json_nested_string(v, "$.a.b").alias("nested"),
        J.json_string(v, "$.n").alias("number"),
        F.unix_seconds(J.json_date_or(v, "$.d", F.lit("2020-01-01").cast("timestamp"))).alias("d"),
    )
    assert [tuple(r) for r in got.collect()] == [("x", None, 1769940000), ("", None, 1577836800), ("", None, 1577836800), ("", None, 1577836800)]
