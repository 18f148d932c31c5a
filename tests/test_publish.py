import json
from datetime import datetime

from helpers import sites
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.operators import publish as P
from corpusloom.options import BuildOptions
from corpusloom.sinks.files import write_files, write_lines
from corpusloom.sinks.manifest import manifest_json_files, parse_manifest_json, read_manifest, write_manifest
from corpusloom.sinks.versions import finished_versions
from corpusloom.sources.tables import MANIFEST

OPTIONS = BuildOptions(as_of="2024-01-01 00:00:00", generator="gen")
SUMMARY = "site string, url string, title string, markdown string, content_hash string, fetched_at timestamp, rank bigint"


def summaries(spark, rows):
    full = [(site, f"https://{site}.com/{name}", title, body, "h", datetime(2024, 1, 1), rank) for rank, (site, name, title, body) in enumerate(rows, 1)]
    named = spark.createDataFrame(full, SUMMARY).withColumn("file_name", U.stable_filename(F.col("url")))
    return named.withColumn("relative_output_path", U.page_path(F.col("file_name")))


ROWS = [("s", "b", "beta", "B\n"), ("s", "a", "Alpha", " A "), ("s", "c", "alpha", "C"), ("s", "z", "straße", "Z"), ("s", "y", "STRASSE", "Y"), ("t", "x", "x", "X")]


def text_of(lines):
    return "\n".join(r.line for r in P.numbered_lines(lines).filter("site = 's'").orderBy("ord").collect())


def test_index(spark):
    table, root = summaries(spark, ROWS), sites(spark, {"s": "https://s.com", "t": "https://t.com", "empty": "https://e.com"})
    files = {r.title: r.file_name for r in table.collect()}
    assert text_of(P.index_lines(table, root, OPTIONS)) == "\n".join(
        [
            "# llms.txt for s.com",
            "",
            "Site root: https://s.com/",
            "Short description: AI-friendly markdown summaries generated by gen.",
            "",
            "## Index",
            *[f"- {t}: https://s.com/ai/pages/{files[t]}" for t in ("Alpha", "alpha", "beta", "STRASSE", "straße")],
        ]
    )
    assert P.numbered_lines(P.index_lines(table, root, OPTIONS)).filter("site = 'empty'").count() == 6


def test_full_corpus(spark):
    table, root = summaries(spark, ROWS[:2]), sites(spark, {"s": "https://s.com"})
    a, b = [r.file_name for r in table.orderBy(F.upper("title")).collect()]
    assert text_of(P.full_lines(table, root, OPTIONS)) == "\n".join(
        [
            "# llms-full.txt for s.com",
            "",
            "Site root: https://s.com/",
            "Description: Full AI-friendly corpus generated by gen.",
            "Generated at (UTC): 2024-01-01T00:00:00.0000000Z",
            "Pages included: 2",
            "",
            "## Index",
            f"- Alpha: https://s.com/ai/pages/{a}",
            f"- beta: https://s.com/ai/pages/{b}",
            "",
            "## Pages",
            "",
            *["---", "Title: Alpha", "URL: https://s.com/a", "Content Hash: h", f"Relative Output Path: ai/pages/{a}", "", "A", ""],
            *["---", "Title: beta", "URL: https://s.com/b", "Content Hash: h", f"Relative Output Path: ai/pages/{b}", "", "B", ""],
        ]
    )


def test_page_files(spark):
    row = P.page_files(summaries(spark, [("s:8080", "a", 'T"', " body \n")]), "gen").first()
    assert row.path.startswith("s_8080/ai/pages/a_") and row.content.startswith('---\ntitle: "T\\""\nsource_url: "https://s:8080.com/a"\n')
    assert row.content.endswith('generator: "gen"\n---\nbody\n')


def test_dedupe_and_collisions(spark):
    table = summaries(spark, ROWS).withColumn("file_name", F.when(F.col("title") == "Alpha", "F.md").when(F.col("title") == "beta", "f.md").when(F.col("title") == "alpha", "F.md").otherwise(F.col("file_name")))
    kept = {r.title for r in P.dedupe_by_filename(table).collect()}
    assert kept == {"beta", "straße", "STRASSE", "x"}
    previous = spark.createDataFrame([("t", "https://other", table.filter("title = 'x'").first().file_name)], "site string, url string, file_name string")
    got = {r.url.rsplit("/", 1)[1]: r.collides for r in P.detect_collision(table, previous).collect()}
    assert got == {"b": False, "a": False, "c": True, "z": False, "y": False, "x": True}


def test_written_text_is_in_order(spark, tmp_path):
    rows = [("s" if i % 3 else "t", str(i), f"title {i * 7919 % 1000:04d}", "x") for i in range(900)]
    table, root = summaries(spark, rows), sites(spark, {"s": "https://s.com", "t": "https://t.com"})
    lines = P.index_lines(table, root, OPTIONS)
    write_lines(lines, str(tmp_path / "out"))
    for site in "st":
        parts = sorted((tmp_path / "out" / f"site={site}").glob("part-*"))
        written = "".join(p.read_text() for p in parts).splitlines()
        want = [r.line for r in P.numbered_lines(lines).filter(F.col("site") == site).orderBy("ord").collect()]
        assert written == want


def test_file_parts_and_export(spark, tmp_path):
    table, root = summaries(spark, ROWS), sites(spark, {"s": "https://s.com", "t": "https://t.com"})
    parts = P.file_parts(P.numbered_lines(P.index_lines(table, root, OPTIONS)), "llms.txt", 8)
    write_files(parts, str(tmp_path / "files"))
    write_files(parts, str(tmp_path / "files"))
    assert sorted(str(p.relative_to(tmp_path / "files")) for p in (tmp_path / "files").rglob("*") if p.is_file()) == ["s/llms.txt", "s/llms.txt.part-00001", "t/llms.txt"]
    whole = (tmp_path / "files/s/llms.txt").read_text() + (tmp_path / "files/s/llms.txt.part-00001").read_text()
    assert whole == text_of(P.index_lines(table, root, OPTIONS)) + "\n"


def test_manifest_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    assert read_manifest(spark, path).count() == 0
    one = spark.createDataFrame([("s", "u", "h", "p", "t", "T")], MANIFEST)
    assert write_manifest(one, path) == 1
    known = read_manifest(spark, path)
    assert write_manifest(known.withColumn("title", F.lit("T2")), path) == 2
    assert read_manifest(spark, path).first().title == "T2" and known.first().title == "T"
    (tmp_path / "m" / "v=3").mkdir()
    assert finished_versions(spark, path) == [1, 2]


def test_manifest_json(spark):
    rows = [("s", 'u"1\\', "h1", "p", "t", "T é"), ("s", "u2", "h2", "p", "t", ""), ("t", "u", "h", "p", "t", "T")]
    table = spark.createDataFrame(rows, MANIFEST)
    files = manifest_json_files(table)
    by_path = {r.path: r.content for r in files.collect()}
    entry = json.loads(by_path["s/manifest.json"])["Entries"]['u"1\\']
    assert entry == {"Url": 'u"1\\', "ContentHash": "h1", "RelativeOutputPath": "p", "LastGeneratedAt": "t", "Title": "T é"}
    back = parse_manifest_json(files.select(F.substring_index("path", "/", 1).alias("site"), "content"))
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def test_parts_have_names_of_their_own_and_are_whole(spark):
    rows = [("s", f"u{i:06d}", "h", "p", "t", "T") for i in range(25)]
    files = manifest_json_files(spark.createDataFrame(rows, MANIFEST), 10)
    assert all(len(json.loads(r.content)["Entries"]) <= 10 for r in files.collect())
    back = parse_manifest_json(files.select(F.substring_index("path", "/", 1).alias("site"), "content"))
    assert sorted(tuple(r) for r in back.collect()) == rows
    places = spark.range(99_990, 100_010).select(F.lit("s").alias("site"), F.lit(1).alias("section"), (F.col("id") + 1).alias("ord"), F.lit("x").alias("line"))
    assert P.file_parts(places, "f", 1).select("path").distinct().count() == 20


def test_equal_ranks_leave_one_page(spark):
    rows = [("s", "u2", "N.md", 1), ("s", "u1", "n.md", 1), ("s", "u3", "other.md", 1)]
    table = spark.createDataFrame(rows, "site string, url string, file_name string, rank long")
    assert sorted(r.url for r in P.dedupe_by_filename(table).collect()) == ["u1", "u3"]


def test_manifest_json_in_any_case(spark):
    content = '{"entries":{"https://s/":{"url":"https://s/","contentHash":"AB","TITLE":"T"}}}'
    files = spark.createDataFrame([("s", content), ("s", "null"), ("s", "{bad"), ("s", "{}")], "site string, content string")
    assert [tuple(r) for r in parse_manifest_json(files).collect()] == [("s", "https://s/", "AB", "", "", "T")]
