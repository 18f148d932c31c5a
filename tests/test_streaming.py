import random
import re
from datetime import datetime, timedelta

import pytest
from helpers import captures, docs, page, sites
from pyspark.sql import functions as F

from corpusloom.functions.url import page_path
from corpusloom.operators.extract import extract_pages
from corpusloom.operators.summarize import as_summaries
from corpusloom.operators.triage import choose_captures, join_capture_fallback, scan_captures
from corpusloom.options import BuildOptions
from corpusloom.plans.build import build_corpus
from corpusloom.session import materialize
from corpusloom.sinks.versions import finished_versions
from corpusloom.sources.tables import MANIFEST
from corpusloom.streaming.change_state import stream_change_state
from corpusloom.streaming.incremental import CorpusState, apply_batch, current_counters, current_documents, current_manifest, stream_incremental

START = datetime(2024, 1, 1)


def arrivals(spark, batches):
    """One table per batch of ``{path: title}``; a later batch is a later crawl."""
    tables, n = [], 0
    for day, batch in enumerate(batches):
        rows = []
        for name, title in batch.items():
            n += 1
            rows.append((n, "s", f"https://s.com/{name}", page(title), {"fetched_at": START + timedelta(days=day)}))
        tables.append(captures(spark, rows))
    return tables


BATCHES = [{"a": "A1", "b": "B1"}, {"a": "A1", "c": "C1"}, {"b": "B2"}, {"b": "B1", "a": "A1"}, {"d": "D1"}]


def expected(spark, tables):
    """Hash of the last version of every page, computed in one go."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    rows = extract_pages(scan_captures(union)).orderBy("fetched_at", "capture_id").collect()
    return {r.url: r.content_hash for r in rows}


def hashes(table):
    return {r.url: r.content_hash for r in table.collect()}


def test_micro_batches_equal_one_run(spark, tmp_path):
    tables = arrivals(spark, BATCHES)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    for table in tables:
        table.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.schema).parquet(source)
        stream_incremental(stream, state, compact_every=2).awaitTermination()
    assert hashes(current_manifest(spark, state)) == expected(spark, tables)
    assert finished_versions(spark, f"{state}/manifest", "snapshot=") == [1, 3]
    changed = {n: spark.read.parquet(f"{state}/changes/batch={n}").count() for n in range(5)}
    assert changed == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1}


def test_any_order_of_batches_equals_the_batch_operators(spark, tmp_path):
    gate = "<html><p>Just a moment</p>" + "x " * 600 + "</html>"
    rows = [
        (1, "s", "https://s.com/a", page("A1"), {"fetched_at": START}),
        (2, "s", "https://s.com/a", page("A2"), {"fetched_at": START + timedelta(days=2)}),
        (3, "s", "https://s.com/b", gate, {"fetched_at": START + timedelta(days=1)}),
        (4, "s", "https://s.com/b", page("B rendered"), {"fetched_at": START, "channel": "rendered"}),
        (5, "s", "https://s.com/c", page("C plain"), {"fetched_at": START}),
        (6, "s", "https://s.com/c", page("C rendered"), {"fetched_at": START, "channel": "rendered"}),
        (7, "s", "https://s.com/c", "busy", {"fetched_at": START - timedelta(days=1), "status": 503}),
    ]
    whole = captures(spark, rows)
    chosen = materialize(choose_captures(whole), "chosen")
    want = hashes(extract_pages(join_capture_fallback(whole, chosen)))
    assert len(want) == 3
    for k, order in enumerate(([0, 1, 2, 3, 4, 5, 6], [6, 5, 4, 3, 2, 1, 0], [3, 1, 6, 2, 0, 5, 4])):
        state = str(tmp_path / str(k))
        for n, start in enumerate(range(0, 7, 3)):
            apply_batch(captures(spark, [rows[i] for i in order[start : start + 3]]), n, state, compact_every=2)
        assert hashes(current_manifest(spark, state)) == want


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    tables = arrivals(spark, BATCHES[:3])
    state = str(tmp_path / "state")
    for n, table in enumerate(tables):
        apply_batch(table, n, state)
    before = hashes(current_manifest(spark, state))
    for n in (1, 2):
        apply_batch(tables[n], n, state)
    assert hashes(current_manifest(spark, state)) == before == expected(spark, tables)


def test_failed_summaries_are_tried_again(spark, tmp_path):
    state, table = str(tmp_path / "state"), arrivals(spark, [{"a": "A", "b": "B"}])[0]

    def partly(pages):
        from corpusloom.operators.summarize import as_summaries

        return as_summaries(pages).withColumn("markdown", F.when(F.col("title") == "A", F.col("markdown")))

    apply_batch(table, 0, state, partly)
    assert list(hashes(current_manifest(spark, state))) == ["https://s.com/a"]
    apply_batch(table, 1, state)
    assert len(hashes(current_manifest(spark, state))) == 2
    assert spark.read.parquet(f"{state}/changes/batch=1").count() == 1


def by_title(pages):
    """Summaries whose file is named by the title's first word, so that pages can claim one file."""
    named = as_summaries(pages).withColumn("file_name", F.concat(F.substring_index("title", " ", 1), F.lit(".md")))
    return named.withColumn("relative_output_path", page_path(F.col("file_name")))


def at(path, day, title="", **more):
    return f"https://s.com/{path}", more.pop("body", page(title)), {"fetched_at": START + timedelta(days=day), **more}


CLASHING = [
    at("b", 0, "One of b"),
    at("a", 1, "One of a"),
    at("c", 0, "Two of c"),
    at("d", 1, "Two of d"),
    at("c", 3, "Three of c"),
    at("e", 0, "Four of e"),
    at("e", 2, body="busy", status=503),
    at("f", 1, "Four of f"),
    at("g", 1, body=page("Five", words=1) + "<p>" + "x" * 700),
    at("h", 0, body="gone", status=404),
    at("h", 1, "Six of h"),
    at("i", 1, "Three of i"),
    at("", 1, "Zero"),
]


def test_clashing_names_in_any_order_equal_one_build(spark, tmp_path):
    rows = [(n, "s", *given) for n, given in enumerate(CLASHING, 1)]
    urls = sorted({r[2] for r in rows})
    listing = "<urlset>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + "</urlset>"
    corpus = build_corpus(
        sites(spark, {"s": "https://s.com/"}),
        captures(spark, rows),
        docs(spark, [{"kind": "sitemap", "ord": 1, "doc_url": "https://s.com/sitemap.xml", "body": listing}]),
        spark.createDataFrame([], MANIFEST),
        spark.createDataFrame([], "site string, url string, relative_output_path string, content string"),
        BuildOptions(as_of="2024-01-01 00:00:00"),
        summarize=by_title,
    )
    manifest, counters = sorted(map(tuple, corpus.manifest.collect())), corpus.counters.collect()
    documents = sorted(map(tuple, corpus.files.collect()))
    assert [m[1][-1] for m in manifest] == ["/", "a", "c", "d", "f", "h"] and counters[0][1:] == (10, 6, 1, 3, 0)
    for k, order in enumerate(([*range(13)], [*range(12, -1, -1)], random.Random(3).sample(range(13), 13))):
        state = str(tmp_path / str(k))
        for n, start in enumerate(range(0, 13, 5)):
            apply_batch(captures(spark, [rows[i] for i in order[start : start + 5]]), n, state, by_title, compact_every=2, as_of="2024-01-01 00:00:00", buckets=3)
        assert sorted(map(tuple, current_manifest(spark, state).select(*corpus.manifest.columns).collect())) == manifest
        assert current_counters(spark, state).select(*corpus.counters.columns).collect() == counters
        assert sorted(map(tuple, current_documents(spark, state).select(*corpus.files.columns).collect())) == documents


def test_a_batch_reads_its_own_buckets_and_counts_what_it_did(spark, tmp_path):
    state = str(tmp_path / "state")
    tables = arrivals(spark, [{"a": "A", "b": "B", "c": "C"}, {"a": "A2"}, {"a": "A2"}])
    seen = [apply_batch(table, n, state) for n, table in enumerate(tables)]
    assert [(s["touched"], s["new"], s["changed"], s["Processed"]) for s in seen] == [(3, 3, 3, 3), (1, 0, 0, 1), (1, 0, 0, 1)]
    stored = CorpusState.stored(spark, state)
    pieces = stored.pieces()["results"]
    assert all(len(list((tmp_path / "state" / name / "batch=1").glob("bucket=*"))) == 1 for name in ("pages", "results", "claims", "manifest"))
    plan = stored.results.newest(spark, pieces, list(pieces)[:1])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)
    with pytest.raises(ValueError):
        apply_batch(tables[0], 3, state, buckets=5)
    # A replay counts what the first attempt counted.
    assert apply_batch(tables[2], 2, state) == seen[2] and current_counters(spark, state).first().discovered == 3


def test_change_state(spark, tmp_path):
    tables = arrivals(spark, BATCHES)
    source, out = str(tmp_path / "in"), tmp_path / "out"
    for table in tables:
        table.coalesce(1).write.mode("append").parquet(source)
        query = (
            stream_change_state(spark.readStream.schema(table.schema).parquet(source))
            .writeStream.format("parquet")
            .option("path", str(out / "data"))
            .option("checkpointLocation", str(out / "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    got = spark.read.parquet(str(out / "data"))
    assert sorted((r.url[-1], r.capture_id) for r in got.collect()) == [("a", 1), ("b", 2), ("b", 5), ("b", 6), ("c", 4), ("d", 8)]


def changes(spark, folder, tables, manifest=None):
    """What the keyed stream emits, one run for each table."""
    for table in tables:
        table.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        emitted = stream_change_state(spark.readStream.schema(table.schema).parquet(f"{folder}/in"), manifest)
        writer = emitted.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/data").collect()


def test_late_versions_are_no_changes_and_the_last_emitted_is_the_newest(spark, tmp_path):
    tables = arrivals(spark, BATCHES)
    want = expected(spark, tables)
    got = changes(spark, tmp_path, [tables[k] for k in (3, 0, 4, 2, 1)])
    last = {}
    for r in sorted(got, key=lambda r: (r.fetched_at, r.capture_id)):
        last[r.url] = r.content_hash
    assert last == want
    assert sorted((r.url[-1], r.capture_id) for r in got) == [("a", 7), ("b", 6), ("c", 4), ("d", 8)]


def test_change_state_begins_with_a_manifest(spark, tmp_path):
    tables = arrivals(spark, [{"a": "A1", "b": "B1"}, {"a": "A1", "b": "B2", "c": "C1"}, {"a": "A2", "c": "C1"}])
    state = str(tmp_path / "state")
    apply_batch(tables[0], 0, state)
    got = changes(spark, tmp_path / "keyed", tables[1:], current_manifest(spark, state).withColumn("content_hash", F.upper("content_hash")))
    assert sorted((r.url[-1], r.capture_id) for r in got) == [("a", 6), ("b", 4), ("c", 5)]
