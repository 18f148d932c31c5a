"""The registered queries: every operator over whole given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.checks import archive as A
from corpusloom.functions import html as H
from corpusloom.functions import text as T
from corpusloom.functions import url as U
from corpusloom.functions.binding import once
from corpusloom.operators import publish as P
from corpusloom.operators.crawl import crawl_bfs
from corpusloom.operators.extract import extract_pages, skip_reason
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
from corpusloom.operators.links import adjacency, link_lists
from corpusloom.operators.merge import distinct_by_url, dry_run_list, take_max_pages
from corpusloom.operators.ranking import first_by_key, first_n
from corpusloom.operators.summarize import as_summaries, attach_responses, build_requests, summarize_pages
from corpusloom.operators.triage import (
    choose_captures,
    join_capture_fallback,
    protection_labels,
    protection_report,
    scan_captures,
)
from corpusloom.operators.url_filter import allowed_by_list, url_allowed, url_allowed_by
from corpusloom.options import BuildOptions
from corpusloom.plans.build import Corpus, build_corpus, join_rest_override, publish_corpus, read_documents
from corpusloom.plans.discover import discover_composite
from corpusloom.session import materialize, scratch_path
from corpusloom.sinks.files import write_lines
from corpusloom.sinks.manifest import manifest_json_files, parse_manifest_json, read_manifest, upsert_version, write_manifest
from corpusloom.sources.channels import effective_docs
from corpusloom.sources.feeds import scan_feeds
from corpusloom.sources.rest import RestListing, rest_detect, scan_rest_items
from corpusloom.sources.sitemaps import scan_sitemaps
from corpusloom.sources.tables import MANIFEST, PRIMARY, RENDERED, captures_of_pages, with_site_defaults
from corpusloom.streaming.change_state import stream_change_state
from corpusloom.streaming.incremental import apply_batch, current_counters, current_documents, current_manifest, stream_incremental

OPTIONS = BuildOptions(as_of="2024-01-01 00:00:00")
INCLUDE = ("*/en/*", "blog.", "*/FR/*page=2*")
EXCLUDE = (".html", " ", "*://m.*")
SMALL_BUDGET = 5
OWN_BUDGET = 500

Query = Callable[[SparkSession, str], DataFrame]


def _canonical_pages(spark: SparkSession, sf: str) -> DataFrame:
    return once(A.read(spark, sf, "pages").select("page_id", "url", "html"), url=U.canonicalize(F.col("url")))


def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return _canonical_pages(spark, sf).select("page_id", "url")


def url_names(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return _canonical_pages(spark, sf).select(
        "page_id",
        U.slug(url).alias("slug"),
        U.stable_filename(url).alias("file_name"),
        U.safe_host(url).alias("safe_host"),
        U.authority_prefix(url).alias("authority"),
        U.fallback_title(url).alias("fallback_title"),
        U.is_http(url).alias("is_http"),
    )


def url_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _canonical_pages(spark, sf).filter(url_allowed(F.col("url"), INCLUDE, EXCLUDE)).select("page_id", "url")


def url_filtered_by_site(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns in columns, different for every host."""
    pages = _canonical_pages(spark, sf).withColumn("host", U.host(F.col("url")))
    none = F.array().cast("array<string>")
    include = F.when(F.col("host").startswith("www."), F.array(F.lit(" "), F.lit("*/EN/*"))).otherwise(none)
    exclude = F.when(F.col("host").startswith("m."), F.array(F.lit("page=2"), F.concat(F.lit("*"), "host", F.lit("/de*"))))
    return pages.filter(url_allowed_by(F.col("url"), include, exclude)).select("page_id", "url")


def url_filtered_by_list(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns of every host in rows: as many to exclude as it has ``.html`` pages, and two to include on ``www.`` hosts."""
    pages = _canonical_pages(spark, sf).withColumn("site", U.host(F.col("url")))
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(.*)\.html$", 1)
    excluded = pages.filter(path != "").select("site", F.lit(True).alias("is_exclude"), path.alias("pattern"))
    both = F.explode(F.array(F.lit("*/EN/*"), F.lit(" ? "))).alias("pattern")
    included = pages.filter(F.startswith("site", F.lit("www."))).select("site").distinct().select("site", F.lit(False).alias("is_exclude"), both)
    return allowed_by_list(pages, excluded.unionByName(included)).select("page_id", "url")


def links(spark: SparkSession, sf: str) -> DataFrame:
    pages = _canonical_pages(spark, sf).withColumn("site", U.host(F.col("url")))
    sites = pages.select("site", F.concat(F.lit("https://"), "site").alias("root_url")).distinct()
    lists = link_lists(pages, materialize(with_site_defaults(sites, OPTIONS), "sites"), keep=["page_id"])
    return lists.select("page_id", F.posexplode("links").alias("link_ord", "link"))


def titles(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return _canonical_pages(spark, sf).select(
        "page_id", H.html_title(html, F.col("url")).alias("title"), H.html_title_regex(html).alias("title_regex")
    )


def _captures(spark: SparkSession, sf: str) -> DataFrame:
    pages = A.site_pages(spark, sf)
    return A.captures(pages, A.page_blocks(pages))


def page_shells(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted responses of the imperfect captures."""
    shells = scan_captures(_captures(spark, sf))
    return shells.select("capture_id", "site", "url", "title", F.length("html").alias("chars"))


def sniffed(spark: SparkSession, sf: str) -> DataFrame:
    body = F.col("body")
    return _captures(spark, sf).select(
        "capture_id",
        H.looks_like_html(body).alias("looks_like_html"),
        H.detect_challenge(body).alias("challenge"),
        H.is_challenge(body).alias("is_challenge"),
        H.is_too_thin(body).alias("is_too_thin"),
    )


def triage(spark: SparkSession, sf: str) -> DataFrame:
    return choose_captures(_captures(spark, sf)).drop("url_key")


def fallback_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Shells of the chosen captures."""
    captures = _captures(spark, sf)
    shells = join_capture_fallback(captures, materialize(choose_captures(captures), "chosen"))
    return shells.select("site", "url", "title", F.sha2("html", 256).alias("html_hash"))


def protection(spark: SparkSession, sf: str) -> DataFrame:
    pages = A.site_pages(spark, sf)
    sites = with_site_defaults(A.sites_of(pages), OPTIONS)
    return protection_report(protection_labels(A.captures(pages, A.page_blocks(pages)), sites))


def _sites(spark: SparkSession, sf: str, options: BuildOptions = OPTIONS) -> tuple[DataFrame, DataFrame]:
    pages = A.site_pages(spark, sf)
    return pages, materialize(with_site_defaults(A.sites_of(pages), options), "sites")


def _ranked(found: DataFrame) -> DataFrame:
    return first_n(found, ["site"], ["ordinal"], A.WHOLE).drop("ordinal")


def sitemap_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages, sites = _sites(spark, sf)
    found = scan_sitemaps(A.sitemap_docs(A.page_blocks(pages)), sites, OPTIONS)
    return _ranked(found)


def rendered_sitemaps(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemaps whose plain answers are refused or challenge pages, read from their rendered copies."""
    pages, sites = _sites(spark, sf)
    docs = A.sitemap_docs(A.page_blocks(pages))
    refused = F.length("site") % 2 == 0
    plain = docs.withColumn("body", F.concat(F.lit("<html>Just a moment, "), "site", F.lit("</html>"))).withColumn(
        "status", F.when(refused, F.lit(503)).otherwise(F.col("status"))
    )
    both = plain.withColumn("channel", F.lit(PRIMARY)).unionByName(docs.withColumn("channel", F.lit(RENDERED)))
    return _ranked(scan_sitemaps(effective_docs(both), sites, OPTIONS))


def feed_urls(spark: SparkSession, sf: str) -> DataFrame:
    """All pages, from feeds in pages."""
    pages, sites = _sites(spark, sf)
    found = scan_feeds(A.feed_pages(A.page_blocks(pages)), sites, OPTIONS)
    return _ranked(found)


def rest_probe(spark: SparkSession, sf: str) -> DataFrame:
    pages, sites = _sites(spark, sf)
    return rest_detect(A.probe_docs(pages), sites)


def _rest(spark: SparkSession, sf: str) -> RestListing:
    pages, sites = _sites(spark, sf)
    return scan_rest_items(A.probe_docs(pages).unionByName(A.listing_docs(pages)), sites, OPTIONS)


def rest_items(spark: SparkSession, sf: str) -> DataFrame:
    listing = _rest(spark, sf)
    ranked = first_n(listing.discovered, ["site"], ["ordinal"], A.WHOLE).select("site", "ordinal", "rank")
    return listing.items.join(ranked, ["site", "ordinal"]).select(
        "site", "rank", "url", "title", F.sha2("html", 256).alias("html_hash"), F.unix_seconds("modified_at").alias("modified")
    )


def rest_status(spark: SparkSession, sf: str) -> DataFrame:
    return _rest(spark, sf).status


def _discovery(spark: SparkSession, sf: str, options: BuildOptions = OPTIONS):
    pages, sites = _sites(spark, sf, options)
    blocks = A.page_blocks(pages)
    captures = A.captures(pages, blocks)
    return discover_composite(sites, captures, A.site_docs(pages, blocks), options), sites, captures


def discovered(spark: SparkSession, sf: str) -> DataFrame:
    return _discovery(spark, sf)[0].urls.select("site", "url", "discovery_method", "depth", "rank")


def discovered_small_budget(spark: SparkSession, sf: str) -> DataFrame:
    """A budget of five pages, where a site has none of its own, with URL patterns: every strategy is cut before the merge filters."""
    options = BuildOptions(max_pages=SMALL_BUDGET, exclude=("*/de/*", "utm_source"))
    return _discovery(spark, sf, options)[0].urls.select("site", "url", "discovery_method", "depth", "rank")


def dry_run(spark: SparkSession, sf: str) -> DataFrame:
    discovery, sites, _ = _discovery(spark, sf)
    return dry_run_list(discovery.urls, sites)


def rest_override(spark: SparkSession, sf: str) -> DataFrame:
    """HTML each discovered page is extracted from."""
    discovery, _, captures = _discovery(spark, sf)
    shells = join_rest_override(discovery, captures)
    return shells.select("site", "url", "rank", "title", F.sha2("html", 256).alias("html_hash"))


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    pages = A.tree_pages(spark, sf)
    roots = pages.select("site", F.concat(F.lit("https://"), "site").alias("root_url"), "max_pages", "max_depth").distinct()
    sites = with_site_defaults(roots, BuildOptions())
    sites = materialize(sites, "sites")
    found = crawl_bfs(adjacency(pages.drop("max_pages", "max_depth"), sites), sites)
    return found.select("site", "url", "depth", F.col("ordinal").alias("rank"))


def distinct_urls(spark: SparkSession, sf: str) -> DataFrame:
    """First page of every canonical URL of a host."""
    pages = _canonical_pages(spark, sf).select(U.host(F.col("url")).alias("site"), "url", F.col("page_id").alias("ordinal"))
    return distinct_by_url(pages)


def budgeted(spark: SparkSession, sf: str) -> DataFrame:
    """The first five pages of every host; hosts with names of even length have a budget of their own of five hundred."""
    pages = _canonical_pages(spark, sf).select(U.host(F.col("url")).alias("site"), "url", F.col("page_id").alias("ordinal"))
    own = F.when(F.length("site") % 2 == 0, F.lit(OWN_BUDGET)).alias("max_pages")
    sites = pages.select("site", F.concat(F.lit("https://"), "site").alias("root_url"), own).distinct()
    return take_max_pages(distinct_by_url(pages), with_site_defaults(sites, BuildOptions(max_pages=SMALL_BUDGET)))


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return extract_pages(_canonical_pages(spark, sf))


def extract(spark: SparkSession, sf: str) -> DataFrame:
    return _extracted(spark, sf).select(
        "page_id", "outcome", "is_skipped", "skip_reason", F.length("markdown").alias("chars"), "content_hash"
    )


def extract_text(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the extracted markdown without its marks."""
    words = F.regexp_replace(F.regexp_replace("markdown", r"[*#\\_]", ""), r"\s+", " ")
    return _extracted(spark, sf).select("page_id", F.sha2(T.trim_ws(words), 256).alias("text_hash"))


def skip_rule(spark: SparkSession, sf: str) -> DataFrame:
    """The length rule on all documents."""
    markdown = T.clean_markdown(F.col("text"))
    reasons = A.read(spark, sf, "documents").select("lang", skip_reason(markdown).alias("reason"))
    return reasons.groupBy("lang", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("pages"))


def _untidy(text: Column) -> Column:
    return F.concat(F.lit(" \t"), F.replace(text, F.lit("\n"), F.lit("\r\n\r\n\n")), F.lit("\r\n "))


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    untidy = _untidy(F.col("text"))
    return A.read(spark, sf, "documents").select(
        "doc_id",
        T.content_sha256(T.clean_markdown(untidy)).alias("clean_hash"),
        T.content_sha256(T.escape_yaml(F.concat(F.lit('"\\'), "text"))).alias("yaml_hash"),
        T.content_sha256(H.html_encode_paragraph(F.col("text"))).alias("encoded_hash"),
    )


def conversation_text(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as REST item bodies: wrapped, sanitised and hashed."""
    noisy = F.concat(F.lit("<SCRIPT>x</script>"), "text", F.lit("<style>y</style><script>open"))
    return A.read(spark, sf, "conversations").select(
        "conv_id", "turn", T.content_sha256(H.wrap_article(H.sanitize_html(noisy))).alias("hash")
    )


def frontmatter(spark: SparkSession, sf: str) -> DataFrame:
    """Page files and the bodies read back from them."""
    pages = A.document_pages(spark, sf)
    title = F.concat("title", F.lit(' "\\'))
    head = T.build_frontmatter(title, F.col("url"), F.col("fetched_at"), T.content_sha256(F.col("markdown")), "corpusloom")
    content = F.concat(head, F.lit("\n"), "markdown", F.lit("\n"))
    return pages.select(
        F.col("rank").alias("doc_id"),
        F.sha2(content, 256).alias("file_hash"),
        F.sha2(T.strip_frontmatter(content), 256).alias("body_hash"),
        F.sha2(T.strip_frontmatter(F.concat(F.lit("---\n"), "markdown")), 256).alias("unclosed_hash"),
    )


def _checked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents against a manifest that knows English ones as they are, German ones with another hash."""
    docs = A.document_pages(spark, sf).withColumn("content_hash", T.content_sha256(T.clean_markdown(F.col("markdown"))))
    known = F.col("lang").isin("en", "de")
    manifest = docs.filter(known).select(
        "site",
        "url",
        F.when(F.col("lang") == "en", F.upper("content_hash")).otherwise(F.sha2("url", 256)).alias("content_hash"),
        F.when(F.col("site") == "src1", F.lit(" ")).otherwise(F.concat(F.lit("ai\\pages/"), U.stable_filename(F.col("url")))).alias("relative_output_path"),
        F.lit("2023-01-01T00:00:00.0000000Z").alias("last_generated_at"),
        F.when(F.col("site") == "src2", F.lit("")).otherwise(F.concat(F.lit("Old "), "title")).alias("title"),
    )
    vanished = manifest.withColumn("url", F.concat("url", F.lit("/gone")))
    manifest = manifest.unionByName(vanished)
    return docs, manifest, join_manifest(docs, manifest)


def cache_split(spark: SparkSession, sf: str) -> DataFrame:
    """Documents against a stored manifest, whose rows stay in their buckets."""
    docs, manifest, _ = _checked(spark, sf)
    path = scratch_path(spark, "manifest")
    write_manifest(manifest, path)
    return join_manifest(docs, read_manifest(spark, path)).select("site", "url", "is_hit")


def cached_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Unchanged pages with the body of the earlier page file; the files of one source are lost."""
    docs, _, checked = _checked(spark, sf)
    head = T.build_frontmatter(F.col("title"), F.col("url"), F.col("fetched_at"), F.col("content_hash"), "corpusloom")
    files = docs.filter("site <> 'src3'").select(
        "site",
        F.concat(F.lit("ai\\pages/"), U.stable_filename(F.col("url"))).alias("relative_output_path"),
        F.concat(head, F.lit("\nSummary of "), "url", F.lit("\n")).alias("content"),
    )
    hits = join_cached_body(checked.filter("is_hit"), files)
    return hits.select("site", "url", "title", "markdown", "content_hash", "file_name", "relative_output_path")


def _answered(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changed pages and their responses: good, null, malformed or without text, by language."""
    misses = checked.filter(~F.col("is_hit")).drop("is_hit", "known_hash", "known_path", "known_title")
    text = F.concat(F.lit(" \n# "), "title", F.lit("\n\n"), "url", F.lit("\n"))
    body = (
        F.when(F.col("lang") == "de", F.lit('{"response": null}'))
        .when((F.col("lang") == "fr") & F.contains("site", F.lit("1")), F.lit("<html>busy</html>"))
        .when(F.col("lang") == "es", F.lit('{"error": "no model"}'))
        .otherwise(F.to_json(F.struct(F.lit("m").alias("model"), text.alias("response"))))
    )
    return misses, misses.select("site", "url", "content_hash", body.alias("body"))


def counters(spark: SparkSession, sf: str) -> DataFrame:
    _, _, checked = _checked(spark, sf)
    misses, responses = _answered(checked)
    done = attach_responses(misses, responses).filter(F.col("markdown").isNotNull()).select("url", F.lit(True).alias("done"))
    short = skip_reason(T.clean_markdown(F.col("title")))
    results = checked.join(done, "url", "left").select(
        "site",
        F.when(F.length("title") < 12, F.lit("FetchFailed"))
        .when(short.isNotNull() & (F.length("title") < 20), F.lit("ExtractionSkipped"))
        .when(F.col("is_hit"), F.lit(CACHED))
        .when(F.col("done"), F.lit(PROCESSED))
        .otherwise(F.lit(FAILED))
        .alias("result"),
    )
    return run_counters(results, checked.select("site"))


def manifest_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The next manifest, written as a version and read back."""
    _, manifest, checked = _checked(spark, sf)
    misses, responses = _answered(checked)
    written = attach_responses(misses, responses).filter(F.col("markdown").isNotNull())
    path = scratch_path(spark, "manifest")
    write_manifest(manifest, path)
    upsert_version(materialize(manifest_entries(written, OPTIONS.as_of), "changed"), path)
    return read_manifest(spark, path)


def manifest_json(spark: SparkSession, sf: str) -> DataFrame:
    """The JSON form in files of a hundred entries, and its rows read back from them."""
    _, manifest, _ = _checked(spark, sf)
    files = manifest_json_files(materialize(manifest, "manifest"), 100)
    return parse_manifest_json(files.select(F.substring_index("path", "/", 1).alias("site"), "content"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    misses, _ = _answered(_checked(spark, sf)[2])
    request = F.col("request")
    return build_requests(misses, "summarizer").select(
        "site",
        "url",
        "content_hash",
        F.sha2(F.get_json_object(request, "$.prompt"), 256).alias("prompt_hash"),
        F.get_json_object(request, "$.model").alias("model"),
        F.get_json_object(request, "$.stream").alias("stream"),
        F.get_json_object(request, "$.temperature").cast("double").alias("temperature"),
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    misses, answers = _answered(_checked(spark, sf)[2])
    return attach_responses(misses, answers).select("site", "url", "title", "markdown", "file_name", "relative_output_path")


def injected_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """An injected function instead of stored responses; it fails on pages without a full stop."""

    def sentences(title: str, url: str, markdown: str) -> str:
        markdown.index(".")
        return f" {title}: {markdown} "

    pages = A.document_pages(spark, sf).withColumn("content_hash", T.content_sha256(F.col("markdown"))).drop("lang")
    return summarize_pages(pages, sentences).select("site", "url", "markdown")


def _corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as finished summaries, and their sites."""
    docs = A.document_pages(spark, sf)
    named = docs.withColumns(
        {
            "content_hash": T.content_sha256(F.col("markdown")),
            "file_name": U.stable_filename(F.col("url")),
        }
    ).withColumn("relative_output_path", U.page_path(F.col("file_name")))
    sites = docs.select("site", F.concat(F.lit("https://"), "site", F.lit(".example.org")).alias("root_url")).distinct()
    return named.drop("lang"), materialize(with_site_defaults(sites, OPTIONS), "sites")


def index(spark: SparkSession, sf: str) -> DataFrame:
    """Index lines of every host over all its pages."""
    pages = _canonical_pages(spark, sf).withColumn("site", U.host(F.col("url")))
    named = pages.select(
        "site",
        "url",
        H.html_title(F.col("html"), F.col("url")).alias("title"),
        U.stable_filename(F.col("url")).alias("file_name"),
        F.col("page_id").alias("rank"),
    )
    sites = pages.select("site", F.concat(F.lit("https://"), "site").alias("root_url")).distinct()
    sites = materialize(with_site_defaults(sites, OPTIONS), "sites")
    summaries = P.dedupe_by_filename(materialize(named, "named"))
    return P.numbered_lines(P.index_lines(summaries, sites, OPTIONS))


def full_corpus(spark: SparkSession, sf: str) -> DataFrame:
    summaries, sites = _corpus(spark, sf)
    lines = P.numbered_lines(P.full_lines(summaries, sites, OPTIONS))
    return lines.select("site", "section", "ord", F.sha2("line", 256).alias("line_hash"))


def page_files(spark: SparkSession, sf: str) -> DataFrame:
    summaries, _ = _corpus(spark, sf)
    return P.page_files(summaries, OPTIONS.generator).select("path", F.sha2("content", 256).alias("content_hash"))


def published_files(spark: SparkSession, sf: str) -> DataFrame:
    """Index files in parts of at most ten entries."""
    summaries, sites = _corpus(spark, sf)
    return P.file_parts(P.numbered_lines(P.index_lines(summaries, sites, OPTIONS)), P.INDEX_FILE, 10)


def published_text(spark: SparkSession, sf: str) -> DataFrame:
    """Index files written as text and read back."""
    summaries, sites = _corpus(spark, sf)
    path = scratch_path(spark, "text")
    write_lines(P.index_lines(summaries, sites, OPTIONS), path)
    return spark.read.text(path).select("site", F.col("value").alias("line"))


def published_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as readers see them after two runs, the second with every third page changed and no other written."""
    summaries, sites = _corpus(spark, sf)
    edited = summaries.filter("rank % 3 = 0").withColumn("markdown", F.concat("markdown", F.lit("\nEdited")))
    return _published(spark, summaries, sites, (summaries, edited))


def published_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after four runs that write less and less, with a compaction after the second."""
    summaries, sites = _corpus(spark, sf)
    runs = [summaries]
    for share in (3, 7, 50):
        runs.append(summaries.filter(f"rank % {share} = 0").withColumn("markdown", F.concat("markdown", F.lit(f"\nEdited {share}"))))
    return _published(spark, summaries, sites, runs, compact_every=2)


def _published(spark: SparkSession, summaries: DataFrame, sites: DataFrame, runs: Sequence[DataFrame], **options) -> DataFrame:
    root = scratch_path(spark, "published")
    for fresh in runs:
        corpus = Corpus(
            discovered=sites,
            counters=sites,
            requests=build_requests(fresh, OPTIONS.model),
            summaries=fresh,
            manifest=upsert_manifest(read_manifest(spark, f"{root}/manifest"), manifest_entries(fresh, OPTIONS.as_of)),
            files=P.page_files(fresh, OPTIONS.generator),
            index=P.index_lines(summaries, sites, OPTIONS),
        )
        publish_corpus(corpus, root, **options)
    return read_documents(spark, root).select("path", F.sha2("content", 256).alias("content_hash"))


def dedupe_names(spark: SparkSession, sf: str) -> DataFrame:
    """Pages named by their whole titles, of which many are copies, in two foldings of case: first by rank."""
    summaries, _ = _corpus(spark, sf)
    # The engines upper-case the sharp s differently, so the names are folded the way index titles are.
    name = F.when(F.col("rank") % 2 == 0, T.ordinal_fold(F.col("title"))).otherwise(F.lower("title"))
    clashing = summaries.withColumn("file_name", F.concat(name, F.lit(".md")))
    return P.dedupe_by_filename(clashing).select("site", "url", "file_name", "rank")


def collisions(spark: SparkSession, sf: str) -> DataFrame:
    """File names from whole titles, which clash where documents are copies, and with those of an earlier run."""
    summaries, _ = _corpus(spark, sf)
    clashing = summaries.withColumn("file_name", F.concat("title", F.lit(".md")))
    previous = clashing.filter("title like 'A%'").select("site", F.concat("url", F.lit("/old")).alias("url"), "file_name")
    return P.detect_collision(clashing, previous)


def corpus_counters(spark: SparkSession, sf: str) -> DataFrame:
    """A whole build over the derived archive, from discovery to the counters."""
    return _build(spark, sf).counters


def corpus_index(spark: SparkSession, sf: str) -> DataFrame:
    """Index of a whole build."""
    return P.numbered_lines(_build(spark, sf).index)


def _build(spark: SparkSession, sf: str):
    pages = A.site_pages(spark, sf)
    files = spark.createDataFrame([], "site string, url string, relative_output_path string, content string")
    manifest = spark.createDataFrame([], MANIFEST)
    blocks = A.page_blocks(pages)
    captures, docs = A.captures(pages, blocks), A.site_docs(pages, blocks)
    return build_corpus(A.sites_of(pages), captures, docs, manifest, files, OPTIONS)


def _stream_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def incremental_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Four arrivals of captures, each a run of the stream that resumes from its checkpoint.

    Three quarters of the pages arrive, then the rest, then changed versions of those with ``.html``, and last an older
    version of the same. The result is compared with one pass of the batch operators over all captures.
    """
    pages = A.read(spark, sf, "pages")
    arrivals, state = scratch_path(spark, "arrivals"), scratch_path(spark, "state")
    late = F.contains("url", F.lit("?page=2"))
    edited, older = (F.replace(F.col("html"), F.lit("</article>"), F.lit(f"<p>{text}</p></article>")) for text in ("Edited", "Older"))
    dotted = pages.filter(F.col("url").endswith(".html"))
    batches = [
        captures_of_pages(pages.filter(~late)),
        captures_of_pages(pages.filter(late), "2024-01-02 00:00:00"),
        captures_of_pages(dotted.withColumn("html", edited).withColumn("page_id", F.col("page_id") + A.RENDERED_IDS), "2024-01-03 00:00:00"),
        captures_of_pages(dotted.withColumn("html", older).withColumn("page_id", F.col("page_id") + 2 * A.RENDERED_IDS), "2023-12-01 00:00:00"),
    ]
    for batch in batches:
        batch.write.mode("append").parquet(arrivals)
        stream_incremental(_stream_of(spark, arrivals), state, compact_every=2).awaitTermination()
    arrived = spark.read.parquet(arrivals)
    pages_of = extract_pages(join_capture_fallback(arrived, materialize(choose_captures(arrived), "chosen")))
    one_go = pages_of.select("site", "url", F.col("content_hash").alias("batch_hash"))
    return current_manifest(spark, state).join(one_go, ["site", "url"], "left").select(
        "site", "url", "title", "relative_output_path", (F.col("content_hash") == F.col("batch_hash")).alias("same_as_batch")
    )


def _clashing_state(spark: SparkSession, sf: str) -> str:
    """State of a stream whose pages are named by the first word of their titles, so that many claim one file.

    The pages with ``?page=2`` arrive first, then the others, and last new versions of those with ``.html``, which all
    give up their names for one that they share.
    """
    pages = A.read(spark, sf, "pages")
    state = scratch_path(spark, "state")
    renamed = F.replace(F.replace(F.col("html"), F.lit("<title>"), F.lit("<title>Zed ")), F.lit("</article>"), F.lit("<p>Edited</p></article>"))
    late = F.contains("url", F.lit("?page=2"))
    dotted = pages.filter(F.col("url").endswith(".html")).withColumn("html", renamed).withColumn("page_id", F.col("page_id") + A.RENDERED_IDS)
    batches = [captures_of_pages(pages.filter(late), "2024-01-02 00:00:00"), captures_of_pages(pages.filter(~late)), captures_of_pages(dotted, "2024-01-03 00:00:00")]

    def by_first_word(texts: DataFrame) -> DataFrame:
        name = F.concat(F.substring_index("title", " ", 1), F.lit(".md"))
        named = as_summaries(texts).withColumn("file_name", name)
        return named.withColumn("relative_output_path", U.page_path(F.col("file_name")))

    for n, batch in enumerate(batches):
        apply_batch(batch, n, state, by_first_word, compact_every=2)
    return state


def stream_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a stream with clashing names: which page owns each file in the end, and with what text."""
    documents = current_documents(spark, _clashing_state(spark, sf))
    return documents.select("site", "url", "path", F.sha2(T.trim_ws(T.strip_frontmatter(F.col("content"))), 256).alias("body_hash"))


def stream_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of the same stream: pages that gave up, won or lost a file on the way count as what they are now."""
    return current_counters(spark, _clashing_state(spark, sf))


def change_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Two crawls of all pages, the second with pages on ``blog.`` hosts changed: versions that differ."""
    pages = A.read(spark, sf, "pages")
    arrivals, out = scratch_path(spark, "arrivals"), scratch_path(spark, "changes")
    edited = F.when(
        F.contains("url", F.lit("//blog.")), F.replace(F.col("html"), F.lit("</article>"), F.lit("<p>Edited</p></article>"))
    ).otherwise(F.col("html"))
    second = pages.withColumn("html", edited).withColumn("page_id", F.col("page_id") + A.RENDERED_IDS)
    for batch in (captures_of_pages(pages), captures_of_pages(second, "2024-02-01 00:00:00")):
        batch.write.mode("append").parquet(arrivals)
        (
            stream_change_state(_stream_of(spark, arrivals))
            .writeStream.format("parquet")
            .option("path", f"{out}/data")
            .option("checkpointLocation", f"{out}/checkpoint")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    return spark.read.parquet(f"{out}/data").select("site", "url", "capture_id")


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        url_canonical,
        url_names,
        url_filtered,
        url_filtered_by_site,
        url_filtered_by_list,
        links,
        titles,
        sniffed,
        page_shells,
        triage,
        fallback_pages,
        protection,
        sitemap_urls,
        rendered_sitemaps,
        feed_urls,
        rest_probe,
        rest_items,
        rest_status,
        discovered,
        discovered_small_budget,
        dry_run,
        rest_override,
        crawl,
        distinct_urls,
        budgeted,
        extract,
        extract_text,
        skip_rule,
        clean_text,
        conversation_text,
        frontmatter,
        cache_split,
        cached_bodies,
        counters,
        manifest_upsert,
        manifest_json,
        requests,
        responses,
        injected_summaries,
        index,
        full_corpus,
        page_files,
        published_files,
        published_text,
        published_documents,
        published_deltas,
        dedupe_names,
        collisions,
        corpus_counters,
        corpus_index,
        incremental_stream,
        stream_owners,
        stream_counters,
        change_stream,
    )
}
