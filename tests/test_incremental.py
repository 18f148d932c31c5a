import json
from datetime import datetime

from helpers import captures, docs, page, sites
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.incremental import (
    join_cached_body,
    join_manifest,
    manifest_entries,
    run_counters,
    upsert_manifest,
)
from corpusloom.operators.summarize import PROMPT, attach_responses, build_requests, response_text, summarize_pages
from corpusloom.options import BuildOptions
from corpusloom.plans.build import DOCUMENTS, build_corpus, documents_as_of, publish_corpus, read_documents, write_documents
from corpusloom.sinks.buckets import bucket_count
from corpusloom.sinks.manifest import parse_manifest_json, read_manifest
from corpusloom.sinks.versions import finished_versions
from corpusloom.sources.page_files import read_page_files
from corpusloom.sources.tables import MANIFEST

NOW = datetime(2024, 1, 2, 3, 4, 5)
PAGES = "site string, url string, title string, markdown string, content_hash string, fetched_at timestamp, rank bigint"


def pages(spark, **texts):
    rows = [("s", f"https://s.com/{k}", k.title(), v, None, NOW, i + 1) for i, (k, v) in enumerate(texts.items())]
    return spark.createDataFrame(rows, PAGES).withColumn("content_hash", T.content_sha256(F.col("markdown")))


def manifest(spark, rows):
    return spark.createDataFrame([("s", f"https://s.com/{u}", h, p, "then", t) for u, h, p, t in rows], MANIFEST)


def hash_of(spark, text):
    return spark.range(1).select(T.content_sha256(F.lit(text))).first()[0]


def test_manifest_join(spark):
    same = hash_of(spark, "text")
    known = manifest(
        spark,
        [("same", same, "p", "t"), ("upper", same.upper(), "p", "t"), ("changed", "0" * 64, "p", "t"), ("blank", same, " ", "t"), ("CASE", same, "p", "t")],
    )
    table = pages(spark, same="text", upper="text", changed="text", blank="text", new="text", case="text")
    got = {r.url.rsplit("/", 1)[1]: r.is_hit for r in join_manifest(table, known).collect()}
    assert got == {"same": True, "upper": True, "changed": False, "blank": False, "new": False, "case": False}


def test_cached_body(spark):
    same = hash_of(spark, "text")
    known = manifest(spark, [("a", same, "ai\\pages/a.md", "Old A"), ("b", same, "ai/pages/b.md", " ")])
    files = spark.createDataFrame([("s", "ai\\pages/a.md", "---\ntitle: x\n---\n\nBody A\n")], "site string, relative_output_path string, content string")
    hits = join_cached_body(join_manifest(pages(spark, a="text", b="text"), known).filter("is_hit"), files)
    got = {r.file_name: (r.title, r.markdown, r.relative_output_path) for r in hits.collect()}
    assert got == {"a.md": ("Old A", "Body A", "ai/pages/a.md"), "b.md": ("B", "", "ai/pages/b.md")}


def test_upsert_keeps_the_vanished(spark):
    old = manifest(spark, [("a", "1", "p", "A"), ("gone", "2", "p", "G")])
    new = manifest(spark, [("a", "9", "q", "A2"), ("b", "3", "p", "B")])
    got = sorted((r.url.rsplit("/", 1)[1], r.content_hash) for r in upsert_manifest(old, new).collect())
    assert got == [("a", "9"), ("b", "3"), ("gone", "2")]


def test_counters(spark):
    rows = [("s", x) for x in ("Processed", "Processed", "Cached", "ExtractionSkipped", "FetchFailed", "Failed")] + [("t", "Cached")]
    table = spark.createDataFrame([("s",), ("t",), ("empty",)], "site string")
    got = {r.site: tuple(r)[1:] for r in run_counters(spark.createDataFrame(rows, "site string, result string"), table).collect()}
    assert got == {"s": (6, 2, 2, 2, 1), "t": (1, 0, 1, 0, 1), "empty": (0, 0, 0, 0, 0)}


def test_requests(spark):
    table = pages(spark, a='say "hi"\n{url}')
    row = build_requests(table, "m").select("request", F.get_json_object("request", "$.prompt").alias("p")).first()
    assert row.p == PROMPT.format(title="A", url="https://s.com/a", markdown='say "hi"\n{url}')
    assert row.request.startswith('{"model":"m","prompt":"You are') and row.request.endswith('"stream":false,"temperature":0.2}')
    assert '"Not specified"' in row.p


def test_response_text(apply):
    values = ['{"response":" a \\n"}', '{"response":null}', '{"response":5}', "{}", "<html>", "[]", None]
    assert apply(response_text, values) == ["a", "", None, None, None, None, None]


def test_attach_responses_matches_the_hash(spark):
    table = pages(spark, a="x", b="y", c="z")
    answers = table.filter("title <> 'C'").select(
        "site",
        "url",
        F.when(F.col("title") == "B", F.lit("stale")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.lit('{"response":"done"}').alias("body"),
    )
    got = {r.title: r for r in attach_responses(table, answers).collect()}
    assert {t: r.markdown for t, r in got.items()} == {"A": "done", "B": None, "C": None}
    assert got["A"].relative_output_path == "ai/pages/" + got["A"].file_name and got["A"].file_name.startswith("a_")


def test_injected_summaries(spark):
    def shout(title, url, markdown):
        if title == "Bad":
            raise RuntimeError
        return f" {title}:{markdown} "

    got = {r.title: r.markdown for r in summarize_pages(pages(spark, good="x", bad="y"), shout).collect()}
    assert got == {"Good": "Good:x", "Bad": None}


def build(spark, bodies, known=None, files=None, **given):
    table = spark.createDataFrame([("s", "https://s.com")], "site string, root_url string")
    root = page("Home", links=["/" + k for k in bodies] + ["/lost"])
    rows = [(0, "s", "https://s.com/", root)] + [(i + 1, "s", f"https://s.com/{k}", b) for i, (k, b) in enumerate(bodies.items())]
    rest = [
        {"kind": "rest_probe", "ord": 1, "body": '{"routes":{}}'},
        {"kind": "rest_pages", "page_no": 1, "body": '[{"link":"https://s.com/two","title":{"rendered":"From REST"},"content":{"rendered":"<p>' + "rest " * 30 + '</p>"}}]'},
    ]
    empty = spark.createDataFrame([], "site string, url string, relative_output_path string, content string")
    return build_corpus(
        table,
        captures(spark, rows),
        docs(spark, rest),
        known if known is not None else spark.createDataFrame([], MANIFEST),
        files if files is not None else empty,
        BuildOptions(full_corpus=True, as_of="2024-01-01 00:00:00"),
        **given,
    )


def test_build_publish_and_run_again(spark, tmp_path):
    bodies = {"one": page("One"), "two": page("Two"), "short": "<main>x</main>"}
    first = build(spark, bodies)
    assert first.counters.first().asDict() == {"site": "s", "discovered": 5, "processed": 3, "skipped": 1, "failed": 1, "cached": 0}
    assert {r.title for r in first.summaries.collect()} == {"Home", "One", "From REST"}
    assert publish_corpus(first, str(tmp_path), export_pages=True) == 1

    known = read_manifest(spark, str(tmp_path / "manifest"))
    sites_table = sites(spark, {"s": "https://s.com"})
    exported = list((tmp_path / "files" / "s" / "ai" / "pages").glob("*.md"))
    assert len(exported) == 3
    files = read_page_files(spark, str(tmp_path / "files"), sites_table)
    assert {r.url for r in files.collect()} == {f"https://s.com/{x}" for x in ("", "one", "two")}
    bodies["one"] = page("One", words=300)
    second = build(spark, bodies, known, read_documents(spark, str(tmp_path)))
    assert second.counters.first().asDict() == {"site": "s", "discovered": 5, "processed": 1, "skipped": 3, "failed": 1, "cached": 2}
    assert second.requests.count() == 1
    texts = {r.title: r.markdown for r in second.summaries.collect()}
    assert texts["From REST"] == ("rest " * 30).strip() and len(texts["One"]) > 1400
    assert publish_corpus(second, str(tmp_path)) == 2
    documents = {r.url: r.content for r in read_documents(spark, str(tmp_path)).collect()}
    assert set(documents) == {f"https://s.com/{x}" for x in ("", "one", "two")} and len(documents["https://s.com/one"]) > 1400
    assert documents["https://s.com/two"] == {r.url: r.content for r in files.collect()}["https://s.com/two"]
    asked = spark.read.json(str(tmp_path / "requests" / "v=2")).first()
    assert (asked.site, asked.url) == ("s", "https://s.com/one") and asked.content_hash and '"prompt"' in asked.request
    listed = parse_manifest_json(spark.read.parquet(str(tmp_path / "manifest-json" / "v=2")).select(F.lit("s").alias("site"), "content"))
    assert listed.count() == 3
    third = build(spark, bodies, read_manifest(spark, str(tmp_path / "manifest")), read_documents(spark, str(tmp_path)))
    assert third.counters.first().cached == 3 and all(r.markdown for r in third.summaries.collect())
    assert {r.url for r in read_manifest(spark, str(tmp_path / "manifest")).collect()} == {f"https://s.com/{x}" for x in ("", "one", "two")}


def test_failed_summaries_leave_the_manifest_alone(spark):
    def fail_on_one(misses):
        def summarize(title, url, markdown):
            if title == "One":
                raise RuntimeError
            return "ok"

        return summarize_pages(misses, summarize)

    corpus = build(spark, {"one": page("One"), "two": page("Two")}, summarize=fail_on_one)
    assert corpus.counters.first().asDict() == {"site": "s", "discovered": 4, "processed": 2, "skipped": 0, "failed": 2, "cached": 0}
    assert {r.title for r in corpus.manifest.collect()} == {"Home", "From REST"}


def test_rest_items_that_differ_in_case_are_one_page(spark):
    table = spark.createDataFrame([("s", "https://s.com"), ("none", None)], "site string, root_url string")
    items = [{"link": f"https://s.com/{n}", "title": {"rendered": n}, "content": {"rendered": f"<p>{n * 20}</p>"}} for n in ("Alpha", "alpha")]
    rest = [{"kind": "rest_probe", "ord": 1, "body": '{"routes":{}}'}, {"kind": "rest_pages", "page_no": 1, "body": json.dumps(items)}]
    empty = spark.createDataFrame([], "site string, url string, relative_output_path string, content string")
    corpus = build_corpus(table, captures(spark, []), docs(spark, rest), spark.createDataFrame([], MANIFEST), empty, BuildOptions())
    assert {r.site: (r.discovered, r.processed, r.failed) for r in corpus.counters.collect()} == {"s": (2, 1, 1), "none": (0, 0, 0)}
    assert [(r.title, r.markdown) for r in corpus.summaries.collect()] == [("alpha", "alpha" * 20)]


def test_plug_points(spark, tmp_path):
    def listed(site_docs, sites, options):
        return sites.select("site", F.lit("https://s.com/two").alias("url"), F.lit("own").alias("discovery_method"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("ordinal"))

    corpus = build(spark, {"one": page("One")}, strategies=[listed], convert=lambda html: "own " * 20)
    assert {r.markdown for r in corpus.summaries.collect()} == {("own " * 20).strip()}
    stored = []
    publish_corpus(corpus, str(tmp_path), write_index=lambda lines, path: stored.append(path), save_manifest=lambda manifest, path: 7)
    assert len(stored) == 2 and not (tmp_path / "manifest").exists()


def test_dry_run(spark):
    table = spark.createDataFrame([("s", "https://s.com", 2)], "site string, root_url string, max_pages int")
    rows = [(0, "s", "https://s.com/", page(links=["/a", "/b"]))]
    nothing = spark.createDataFrame([], MANIFEST)
    files = spark.createDataFrame([], "site string, url string, relative_output_path string, content string")
    corpus = build_corpus(table, captures(spark, rows), docs(spark, [{"kind": "feed", "body": ""}]), nothing, files, BuildOptions(dry_run=True))
    assert [(r.rank, r.url) for r in corpus.discovered.orderBy("rank").collect()] == [(1, "https://s.com/"), (2, "https://s.com/a")]
    assert corpus.counters.first().discovered == 2 and corpus.extracted is None


def test_manifest_entries(spark):
    summaries = attach_responses(
        pages(spark, a="x"), pages(spark, a="x").select("site", "url", "content_hash", F.lit('{"response":"r"}').alias("body"))
    )
    row = manifest_entries(summaries, "2024").first()
    assert (row.url, row.title, row.last_generated_at, row.content_hash) == ("https://s.com/a", "A", "2024", hash_of(spark, "x"))


def test_documents_are_written_as_deltas_and_compacted(spark, tmp_path):
    root = str(tmp_path)
    columns = [c.split()[0] for c in DOCUMENTS.split(", ")]

    def publish(run, changed):
        rows = [("s", f"https://s.com/{n}", f"s/{n}.md", f"{n}.md", f"text {n} of run {run}") for n in changed]
        write_documents(spark.createDataFrame(rows, DOCUMENTS), root, run, 3)

    def read(run):
        rows = documents_as_of(spark, root, run).select(*columns).collect()
        assert len({r.path for r in rows}) == len(rows)
        return {int(r.url.rsplit("/", 1)[1]): r.content for r in rows}

    want, states = {}, {}
    for run, changed in enumerate([range(20), [3], [3, 25], [4, 25], [], [5], [25]], 1):
        publish(run, changed)
        want |= {n: f"text {n} of run {run}" for n in changed}
        states[run] = dict(want)
        assert read(run) == want
    # Earlier runs stay readable, and a run that is repeated, also one that compacts, replaces its own attempt.
    assert all(read(run) == states[run] for run in states)
    assert finished_versions(spark, f"{root}/documents", "base=") == [3, 6]
    assert spark.read.parquet(f"{root}/documents/v=2").count() == 1
    publish(6, [6])
    assert read(6) == states[5] | {6: "text 6 of run 6"}
    assert read(0) == {}


def test_stored_documents_stay_where_they_are(spark, tmp_path, monkeypatch):
    """Neither merging on read nor compaction moves or sorts a text, also where the changed paths are too many to broadcast."""
    monkeypatch.setattr("corpusloom.plans.build.is_small", lambda table: False)
    root, partitions = str(tmp_path), spark.conf.get("spark.sql.shuffle.partitions")

    def documents(text, *numbers):
        rows = [("s", f"https://s.com/{n}", f"s/{n}.md", f"{n}.md", f"{text} {n}") for n in numbers]
        return spark.createDataFrame([*rows, ("s", "https://s.com/none", None, "none.md", text)], DOCUMENTS)

    def read(run):
        frame = documents_as_of(spark, root, run)
        rows = sorted((r.path or "", r.content) for r in frame.collect())
        moved = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in moved and "Sort" not in moved.replace("SortedBucket", ""), moved
        return rows

    def want(*texts):
        return sorted([("", text) for text in texts])

    write_documents(documents("a", *range(40)), root, 1, 3)
    write_documents(documents("b", 3, 40), root, 2, 3)
    whole = {f"s/{n}.md": f"a {n}" for n in range(40)} | {f"s/{n}.md": f"b {n}" for n in (3, 40)}
    assert read(2) == sorted([*whole.items(), *want("a", "b")])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        write_documents(documents("c", 4), root, 3, 3)
        whole |= {"s/4.md": "c 4"}
        assert bucket_count(spark, f"{root}/documents/v=3") == int(partitions)
        assert bucket_count(spark, f"{root}/documents/base=3") == 5
        assert read(3) == sorted([*whole.items(), *want("a", "b", "c")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    documents("d", 5).write.parquet(f"{root}/documents/v=4")  # as runs wrote them before they had buckets
    write_documents(documents("e", 6), root, 5, 3)
    whole |= {"s/5.md": "d 5", "s/6.md": "e 6"}
    rows = documents_as_of(spark, root, 5).collect()
    assert sorted((r.path or "", r.content) for r in rows) == sorted([*whole.items(), *want("a", "b", "c", "d", "e")])


def test_several_answers_to_one_request_are_one_summary(spark):
    pages = spark.createDataFrame([(1, "s", "https://s.com/a", "A", "h"), (2, "s", "https://s.com/b", "B", "h")], "rank long, site string, url string, title string, content_hash string")
    pages = pages.withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp")).withColumn("markdown", F.lit("m"))
    bodies = [("a", '{"response": "y"}'), ("a", '{"response": "x"}'), ("a", '{"response": ""}'), ("a", "broken"), ("b", '{"response": null}'), ("b", "{}")]
    answers = spark.createDataFrame([("s", f"https://s.com/{n}", "h", body) for n, body in bodies], "site string, url string, content_hash string, body string")
    assert {r.url[-1]: r.markdown for r in attach_responses(pages, answers).collect()} == {"a": "x", "b": ""}
    assert attach_responses(pages, answers).count() == 2
