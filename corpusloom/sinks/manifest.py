"""The manifest as a versioned table, and its JSON exchange form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.incremental import upsert_manifest
from corpusloom.operators.publish import file_parts, numbered_lines
from corpusloom.sinks.buckets import bucket_count, dealt, read_buckets, write_buckets
from corpusloom.sinks.versions import finished_versions, next_version
from corpusloom.sources.tables import MANIFEST

MANIFEST_FILE = "manifest.json"
KEY = ("site", "url")

# Field names of a manifest entry in the JSON form, and the columns they fill.
JSON_FIELDS = (
    ("Url", "url"),
    ("ContentHash", "content_hash"),
    ("RelativeOutputPath", "relative_output_path"),
    ("LastGeneratedAt", "last_generated_at"),
    ("Title", "title"),
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest, in buckets of site and URL; empty when none was written yet."""
    done = finished_versions(spark, path)
    return read_buckets(spark, f"{path}/v={done[-1]}", MANIFEST, KEY) if done else spark.createDataFrame([], MANIFEST)


def _buckets(spark: SparkSession, path: str, given: int | None) -> int:
    """As given, else as the newest version has, else as the session shuffles."""
    done = finished_versions(spark, path)
    known = bucket_count(spark, f"{path}/v={done[-1]}") if done and not given else None
    return given or known or int(spark.conf.get("spark.sql.shuffle.partitions"))


def _columns(rows: DataFrame) -> DataFrame:
    return rows.select("site", "url", "content_hash", "relative_output_path", "last_generated_at", "title")


def write_manifest(manifest: DataFrame, path: str, buckets: int | None = None) -> int:
    """Write the next manifest version. The version it was derived from stays readable.

    Without ``buckets`` a version has as many as the one before, the first as many as the session has shuffle partitions.
    """
    spark = manifest.sparkSession
    version, buckets = next_version(spark, path), _buckets(spark, path, buckets)
    write_buckets(dealt(_columns(manifest), KEY, buckets), f"{path}/v={version}", KEY, buckets)
    return version


def upsert_version(changed: DataFrame, path: str) -> int:
    """Write the next version: the newest one with ``changed`` rows in place of theirs.

    Only changed rows move; those that stay go from their buckets to the same buckets of the next version.
    """
    spark = changed.sparkSession
    done = finished_versions(spark, path)
    buckets = bucket_count(spark, f"{path}/v={done[-1]}") if done else None
    if buckets is None:
        return write_manifest(upsert_manifest(read_manifest(spark, path), changed), path)
    version = next_version(spark, path)
    write_buckets(upserted(spark, changed, path, buckets), f"{path}/v={version}", KEY, buckets)
    return version


def upserted(spark: SparkSession, changed: DataFrame, path: str, buckets: int) -> DataFrame:
    """Rows of the next version, each in a task of its bucket."""
    return upsert_manifest(read_manifest(spark, path), dealt(_columns(changed), KEY, buckets))


def parse_manifest_json(files: DataFrame) -> DataFrame:
    """Manifest rows of JSON files ``(site, content)``; property names may have any case.

    The entry's key is its URL. A ``null`` or unreadable file has no entries.
    """
    parsed = F.from_json("content", "map<string,map<string,map<string,string>>>")
    entries = files.select("site", F.explode(parsed).alias("part", "entries")).filter(F.lower("part") == "entries")
    rows = entries.select("site", F.explode("entries").alias("key", "fields")).withColumn(
        "fields", F.transform_keys("fields", lambda k, _: F.lower(k))
    )

    def field(name: str):
        return F.coalesce(F.try_element_at("fields", F.lit(name.lower())), F.lit(""))

    columns = [F.col("key").alias("url") if c == "url" else field(name).alias(c) for name, c in JSON_FIELDS]
    return rows.select("site", *columns)


def manifest_json_lines(manifest: DataFrame) -> DataFrame:
    """Line table of the JSON form's entries, in URL order, as for any published file."""
    entry = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in JSON_FIELDS]))
    key = F.to_json(F.array("url"))
    return manifest.select(
        "site",
        F.lit(1).alias("section"),
        F.col("url").alias("fold"),
        F.lit(0).cast("bigint").alias("rank"),
        F.concat(F.lit("    "), F.substring(key, F.lit(2), F.length(key) - 2), F.lit(": "), entry).alias("line"),
    )


def manifest_json_files(manifest: DataFrame, entries_per_file: int = 100_000) -> DataFrame:
    """``(path, content)`` of the JSON form.

    Every file is a whole JSON document, also each part of a site with many entries; a reader takes the entries of all.
    """
    numbered = numbered_lines(manifest_json_lines(manifest))
    return file_parts(numbered, MANIFEST_FILE, entries_per_file, head='{\n  "Entries": {\n', between=",\n", tail="\n  }\n}\n")
