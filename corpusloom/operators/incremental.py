"""Change detection against the manifest, and its upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import is_blank, strip_frontmatter
from corpusloom.operators.extract import SKIPPED, SUCCESS
from corpusloom.operators.triage import FETCH_FAILED

MANIFEST_COLUMNS = ("site", "url", "content_hash", "relative_output_path", "last_generated_at", "title")

CACHED = "Cached"
PROCESSED = "Processed"
FAILED = "Failed"


def join_manifest(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages with their earlier manifest entry and whether it still holds.

    A hit needs the same URL, the same hash (ignoring case) and a known output path. The join is on
    the URL alone so that changed pages stay visible as misses.
    """
    known = manifest.select(
        "site",
        "url",
        F.col("content_hash").alias("known_hash"),
        F.col("relative_output_path").alias("known_path"),
        F.col("title").alias("known_title"),
    )
    hit = (F.lower("known_hash") == F.lower("content_hash")) & ~is_blank(F.col("known_path"))
    return pages.join(known, ["site", "url"], "left").withColumn("is_hit", F.coalesce(hit, F.lit(False)))


def join_cached_body(hits: DataFrame, page_files: DataFrame) -> DataFrame:
    """Summaries of unchanged pages, read from the page files of an earlier run.

    ``page_files`` has ``(site, relative_output_path, content)``. A missing file gives an empty body.
    """
    files = page_files.select("site", F.col("relative_output_path").alias("known_path"), "content")
    return hits.join(files, ["site", "known_path"], "left").select(
        "site",
        "url",
        F.when(is_blank(F.col("known_title")), F.col("title")).otherwise(F.col("known_title")).alias("title"),
        F.coalesce(strip_frontmatter(F.col("content")), F.lit("")).alias("markdown"),
        F.col("known_hash").alias("content_hash"),
        F.regexp_extract("known_path", "[^/]*$", 0).alias("file_name"),
        F.replace(F.col("known_path"), F.lit("\\"), F.lit("/")).alias("relative_output_path"),
        "fetched_at",
        "rank",
    )


def manifest_entries(summaries: DataFrame, as_of: str) -> DataFrame:
    """Manifest rows of freshly generated summaries."""
    return summaries.select(
        "site", "url", "content_hash", "relative_output_path", F.lit(as_of).alias("last_generated_at"), "title"
    )


def upsert_manifest(manifest: DataFrame, changed: DataFrame) -> DataFrame:
    """Changed rows replace theirs; all other entries, also of vanished pages, stay."""
    kept = manifest.join(changed.select("site", "url"), ["site", "url"], "left_anti")
    return kept.select(*MANIFEST_COLUMNS).unionByName(changed.select(*MANIFEST_COLUMNS))


def run_counters(results: DataFrame, sites: DataFrame) -> DataFrame:
    """Counters of every site over one row per discovered page with its final ``result``.

    Cached pages count as skipped too. A site without a discovered page has zeros.
    """
    result = F.col("result")
    counted = results.groupBy("site").agg(
        F.count("*").alias("discovered"),
        F.count_if(result == PROCESSED).alias("processed"),
        F.count_if(result.isin(SKIPPED, CACHED)).alias("skipped"),
        F.count_if(result.isin(FETCH_FAILED, FAILED)).alias("failed"),
        F.count_if(result == CACHED).alias("cached"),
    )
    return sites.select("site").distinct().join(counted, "site", "left").fillna(0, ["discovered", "processed", "skipped", "failed", "cached"])


def succeeded(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("outcome") == SUCCESS)
