from datetime import datetime

from pyspark.sql import functions as F

from corpusloom.functions import text as T


def test_trim_ws(apply):
    assert apply(T.trim_ws, [" a ", "\t\n\u00a0\u2003a b\u3000\x85", "", "\u200ba"]) == ["a", "a b", "", "\u200ba"]
    assert apply(T.is_blank, [None, "", " \u00a0\n", "x", "\u200b"]) == [True, True, True, False, False]


def test_clean_markdown(apply):
    assert apply(T.clean_markdown, [None, "a\r\nb", "a\n\n\n\nb\n\n\nc", "a\n\nb", "  x \r\n\r\n\r\n", "a\rb"]) == [
        "",
        "a\nb",
        "a\n\nb\n\nc",
        "a\n\nb",
        "x",
        "a\rb",
    ]


def test_escape_yaml(apply):
    assert apply(T.escape_yaml, [None, 'a"b', "a\\b", '\\"']) == ["", 'a\\"b', "a\\\\b", '\\\\\\"']


def test_content_hash(apply):
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert apply(T.content_sha256, [None, ""]) == [empty, empty]


def test_strip_frontmatter(apply):
    cases = {
        " none ": "none",
        "---\na: 1\n---\nbody\n---\ntail ": "body\n---\ntail",
        "---\r\na: 1\r\n---\r\nbody": "body",
        "\n  ---\nx\n --- \nbody": "body",
        "---\nopen": "---\nopen",
        "--- title\n---\nx\n---\nbody": "body",
        "text\n---\nx\n---\ny": "text\n---\nx\n---\ny",
        "---\na\n---": "",
    }
    assert apply(T.strip_frontmatter, list(cases)) == list(cases.values())


def test_frontmatter(spark):
    df = spark.createDataFrame([('T "q" \\', "https://h/", datetime(2024, 5, 6, 7, 8, 9, 123456), "abc")], "t string, u string, f timestamp, h string")
    built = df.select(T.build_frontmatter(F.col("t"), F.col("u"), F.col("f"), F.col("h"), "gen")).first()[0]
    assert built.splitlines() == [
        "---",
        'title: "T \\"q\\" \\\\"',
        'source_url: "https://h/"',
        f'fetched_at: "{df.select(F.date_format("f", "yyyy-MM-dd")).first()[0]}T{df.select(F.date_format("f", "HH:mm:ss")).first()[0]}.1234560Z"',
        'content_hash: "abc"',
        'generator: "gen"',
        "---",
    ]


def test_ordinal_fold(apply):
    assert apply(T.ordinal_fold, ["straße", "É", "é"]) == ["STRAßE", "É", "É"]
