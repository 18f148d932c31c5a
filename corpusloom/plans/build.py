"""A whole corpus build."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions.markdown import main_markdown
from corpusloom.operators.extract import SUCCESS, extract_pages
from corpusloom.operators.incremental import (
    CACHED,
    FAILED,
    PROCESSED,
    join_cached_body,
    join_manifest,
    manifest_entries,
    run_counters,
    upsert_manifest,
)
from corpusloom.operators.merge import dry_run_list
from corpusloom.operators.publish import (
    FULL_FILE,
    INDEX_FILE,
    dedupe_by_filename,
    detect_collision,
    full_lines,
    index_lines,
    page_files,
)
from corpusloom.operators.summarize import as_summaries, build_requests
from corpusloom.operators.triage import FETCH_FAILED, join_capture_fallback, match_captures
from corpusloom.options import BuildOptions
from corpusloom.plans.discover import Discovery, Strategy, discover_composite, last_items
from corpusloom.session import broadcast_if_small, is_small, materialize, scratch_path
from corpusloom.sinks.buckets import bucket_count, dealt, read_buckets, write_buckets
from corpusloom.sinks.files import write_files, write_lines
from corpusloom.sinks.manifest import manifest_json_files, write_manifest
from corpusloom.sinks.versions import finished_versions
from corpusloom.sources.feeds import scan_feeds
from corpusloom.sources.sitemaps import scan_sitemaps
from corpusloom.sources.tables import with_site_defaults


@dataclass(frozen=True)
class Corpus:
    """Tables of a finished run; all but ``discovered`` and ``counters`` are None after a dry run."""

    discovered: DataFrame
    counters: DataFrame
    extracted: DataFrame | None = None
    requests: DataFrame | None = None
    summaries: DataFrame | None = None
    manifest: DataFrame | None = None
    files: DataFrame | None = None
    index: DataFrame | None = None
    full: DataFrame | None = None


def join_rest_override(discovery: Discovery, captures: DataFrame) -> DataFrame:
    """Page shells of the discovered URLs: REST-rendered HTML where listed, else the chosen capture."""
    wanted = discovery.urls.select("site", "url", "url_key", "rank")
    items = last_items(discovery.rest.items).select(
        "site",
        "url_key",
        "title",
        H.wrap_article(F.col("html")).alias("html"),
        F.col("modified_at").alias("fetched_at"),
    )
    rendered = wanted.join(items, ["site", "url_key"]).select("site", "url", "rank", "title", "html", "fetched_at")
    others = wanted.join(items.select("site", "url_key"), ["site", "url_key"], "left_anti")
    sources = match_captures(others, discovery.chosen).filter(F.col("capture_id").isNotNull())
    sources = materialize(sources.select("capture_id", "url", "rank"), "sources")
    shells = join_capture_fallback(captures, sources, carry=["rank"])
    return rendered.unionByName(shells.select(*rendered.columns))


def build_corpus(
    sites: DataFrame,
    captures: DataFrame,
    site_docs: DataFrame,
    manifest: DataFrame,
    previous_files: DataFrame,
    options: BuildOptions,
    summarize: Callable[[DataFrame], DataFrame] = as_summaries,
    strategies: Sequence[Strategy] = (scan_sitemaps, scan_feeds),
    convert: Callable[[str], str | None] = main_markdown,
) -> Corpus:
    """Discover, extract, compare with the manifest, summarise what changed, and lay out the files.

    ``previous_files`` has ``(site, url, relative_output_path, content)`` of the last run. ``summarize`` maps
    changed pages to summary rows with a null ``markdown`` where it failed: ``attach_responses`` or
    ``summarize_pages`` with their second argument bound. The default publishes the page's own markdown.
    ``strategies`` list URLs after the REST listing and before the crawl; ``convert`` turns a page into markdown.
    """
    sites = materialize(with_site_defaults(sites, options), "sites")
    discovery = discover_composite(sites, captures, site_docs, options, strategies)
    urls = discovery.urls
    if options.dry_run:
        listed = dry_run_list(urls, sites)
        return Corpus(listed, run_counters(listed.select("site", F.lit("Listed").alias("result")), sites))

    extracted = materialize(extract_pages(join_rest_override(discovery, captures), convert), "extracted")
    # The comparison needs hashes only; the text of unchanged pages is not moved at all.
    usable = extracted.filter(F.col("outcome") == SUCCESS)
    checked = materialize(join_manifest(usable.drop("markdown"), manifest), "checked")
    changed = broadcast_if_small(checked.filter(~F.col("is_hit")).select("site", "url"))
    misses = usable.join(changed, ["site", "url"], "left_semi")
    cached = join_cached_body(checked.filter("is_hit"), previous_files)
    answered = materialize(summarize(misses), "summaries")
    written = answered.filter(F.col("markdown").isNotNull())
    earlier = previous_files.select("site", "url", F.regexp_extract("relative_output_path", "[^/]*$", 0).alias("file_name"))
    blocked = materialize(detect_collision(written, earlier).filter("collides").select("site", "url"), "blocked")
    fresh = written.join(broadcast_if_small(blocked), ["site", "url"], "left_anti")

    summaries = materialize(dedupe_by_filename(fresh.unionByName(cached)), "corpus")
    results = (
        urls.select("site", "url")
        .join(extracted.select("site", "url", "outcome"), ["site", "url"], "left")
        .join(checked.select("site", "url", "is_hit"), ["site", "url"], "left")
        .join(fresh.select("site", "url", F.lit(True).alias("done")), ["site", "url"], "left")
        .select(
            "site",
            F.when(F.col("outcome").isNull(), F.lit(FETCH_FAILED))
            .when(F.col("outcome") != SUCCESS, F.col("outcome"))
            .when(F.col("is_hit"), F.lit(CACHED))
            .when(F.col("done"), F.lit(PROCESSED))
            .otherwise(F.lit(FAILED))
            .alias("result"),
        )
    )
    return Corpus(
        discovered=urls,
        counters=run_counters(results, sites),
        extracted=extracted,
        requests=build_requests(misses, options.model),
        summaries=summaries,
        manifest=upsert_manifest(manifest, manifest_entries(fresh, options.as_of)),
        files=page_files(fresh, options.generator),
        index=index_lines(summaries, sites, options),
        full=full_lines(summaries, sites, options) if options.full_corpus else None,
    )


DOCUMENTS = "site string, url string, path string, relative_output_path string, content string"
COLUMNS = tuple(c.split()[0] for c in DOCUMENTS.split(", "))
PATH = ("path",)


BASE = "base="


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """Page documents as of the last finished run, also those that it did not write anew; the next run's ``previous_files``."""
    done = finished_versions(spark, f"{root}/manifest")
    return documents_as_of(spark, root, done[-1] if done else 0)


def _versions(spark: SparkSession, root: str, run: int, again: bool = False) -> list[tuple[int, str]]:
    """Numbers and folders of the last compacted version up to a run and of all runs since, ascending."""
    folder = f"{root}/documents"
    bases = [v for v in finished_versions(spark, folder, BASE) if v <= run and (v < run or not again)]
    since = bases[-1] if bases else 0
    later = [(v, f"{folder}/v={v}") for v in finished_versions(spark, folder) if since < v <= run]
    return [(since, f"{folder}/{BASE}{since}"), *later] if bases else later


def _newest(spark: SparkSession, versions: list[tuple[int, str]], buckets: int) -> DataFrame:
    """The number of the newest version of each path, stored in ``buckets``; paths of the first version only are left out."""
    paths = [read_buckets(spark, path, DOCUMENTS, PATH).select("path", F.lit(v).alias("run")) for v, path in versions[1:]]
    newest = dealt(reduce(DataFrame.unionByName, paths), PATH, buckets).groupBy("path").agg(F.max("run").alias("newest"))
    target = scratch_path(spark, "paths")
    write_buckets(newest, target, PATH, buckets)
    return read_buckets(spark, target, "path string, newest int", PATH)


def _surviving(spark: SparkSession, version: tuple[int, str], newest: DataFrame) -> DataFrame:
    """A version's documents that no later one replaces. Its texts stay in their buckets, where the paths are brought."""
    number, path = version
    stored, buckets = read_buckets(spark, path, DOCUMENTS, PATH), bucket_count(spark, path)
    replaced = newest.filter(F.col("newest") > number).select("path")
    # Hashing the paths of a bucket spares sorting its texts.
    replaced = dealt(replaced, PATH, buckets).hint("shuffle_hash") if buckets else replaced
    return stored.join(replaced, "path", "left_anti").select(*COLUMNS)


def documents_as_of(spark: SparkSession, root: str, run: int) -> DataFrame:
    """Documents after a run: the last compacted ones, and those of all runs since, of each path the newest.

    Only paths are compared. Those that runs since the compaction wrote are broadcast when counted to be few; else they
    go to the buckets of the texts, which stay where they are read.
    """
    versions = _versions(spark, root, run)
    if not versions:
        return spark.createDataFrame([], DOCUMENTS)
    if len(versions) == 1:
        return read_buckets(spark, versions[0][1], DOCUMENTS, PATH)
    newest = _newest(spark, versions, _buckets(spark, versions))
    if not is_small(newest):
        return reduce(DataFrame.unionByName, [_surviving(spark, version, newest) for version in versions])
    stored = [read_buckets(spark, path, DOCUMENTS, PATH).withColumn("_run", F.lit(v)) for v, path in versions]
    joined = reduce(DataFrame.unionByName, stored).join(F.broadcast(newest), "path", "left")
    return joined.filter(F.col("newest").isNull() | (F.col("_run") == F.col("newest"))).select(*COLUMNS)


def _buckets(spark: SparkSession, versions: list[tuple[int, str]]) -> int:
    """As the newest version that is in buckets has, else as the session shuffles."""
    known = [n for _, path in versions if (n := bucket_count(spark, path))]
    return known[-1] if known else int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_documents(files: DataFrame, root: str, run: int, compact_every: int) -> None:
    """Writes the documents of a run and, after every ``compact_every`` runs, all documents together, in buckets of path.

    A run moves and writes the texts that it changed; a compaction writes texts from their buckets to the same ones, and
    moves them only where the session's shuffle partitions, and so the buckets to be, are others than before. A run that
    is repeated writes the same versions again.
    """
    spark, folder = files.sparkSession, f"{root}/documents"
    fresh, buckets = files.select(*COLUMNS), _buckets(spark, _versions(spark, root, run - 1))
    write_buckets(dealt(fresh, PATH, buckets), f"{folder}/v={run}", PATH, buckets, sort_by=PATH)
    bases = [v for v in finished_versions(spark, folder, BASE) if v < run]
    if run - (bases[-1] if bases else 0) < compact_every:
        return
    versions, wanted = _versions(spark, root, run, again=True), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if len(versions) == 1:
        whole = dealt(read_buckets(spark, versions[0][1], DOCUMENTS, PATH), PATH, wanted)
    else:
        newest = _newest(spark, versions, wanted)
        parts = [(_surviving(spark, version, newest), bucket_count(spark, version[1])) for version in versions]
        whole = reduce(DataFrame.unionByName, [part if n == wanted else dealt(part, PATH, wanted) for part, n in parts])
    write_buckets(whole, f"{folder}/{BASE}{run}", PATH, wanted, sort_by=PATH)


def publish_corpus(
    corpus: Corpus,
    root: str,
    export_pages: bool = False,
    write_index: Callable[[DataFrame, str], None] = write_lines,
    save_manifest: Callable[[DataFrame, str], int] = write_manifest,
    compact_every: int = 20,
) -> int:
    """Write a finished run below ``root`` and return the number of the new manifest version.

    Every run writes versions of its own and changes none that a reader may hold: the documents that it changed, and all
    of them together after every ``compact_every`` runs; index and full corpus; requests with the keys that their answers
    need, as compressed lines of JSON; the manifest's JSON form. With ``export_pages`` changed documents also become one file each. The manifest comes
    last, so a run that fails before it is simply repeated. ``write_index`` and ``save_manifest`` stand in for
    other stores.
    """
    spark = corpus.manifest.sparkSession
    done = finished_versions(spark, f"{root}/manifest")
    number = done[-1] + 1 if done else 1
    run = f"v={number}"
    write_documents(corpus.files, root, number, compact_every)
    if export_pages:
        write_files(corpus.files, f"{root}/files")
    write_index(corpus.index, f"{root}/{INDEX_FILE}/{run}")
    if corpus.full is not None:
        write_index(corpus.full, f"{root}/{FULL_FILE}/{run}")
    corpus.requests.write.mode("overwrite").option("compression", "gzip").json(f"{root}/requests/{run}")
    manifest = materialize(corpus.manifest, "manifest")
    manifest_json_files(manifest).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/manifest-json/{run}")
    return save_manifest(manifest, f"{root}/manifest")
