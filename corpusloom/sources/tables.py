"""Shapes of the engine's tables and small helpers over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.operators.ranking import SALTS
from corpusloom.options import BuildOptions
from corpusloom.session import is_small

# One row per stored response of a page. ``capture_id`` identifies the response.
CAPTURES = (
    "capture_id bigint, site string, url string, status int, content_type string, body string, "
    "fetched_at timestamp, channel string, attempt int"
)
# One row per stored sitemap, feed or REST response; a ``channel`` column may tell rendered copies from plain ones.
SITE_DOCS = (
    "site string, kind string, doc_url string, candidate_ord int, page_no int, total_pages int, "
    "status int, content_type string, body string"
)
MANIFEST = (
    "site string, url string, content_hash string, relative_output_path string, last_generated_at string, title string"
)
DISCOVERED = ("site", "url", "discovery_method", "depth", "ordinal")

PRIMARY = "http"
RENDERED = "rendered"


def with_site_defaults(sites: DataFrame, options: BuildOptions) -> DataFrame:
    """The ``sites`` table with every option filled in and the root in canonical form."""

    def given(name: str, kind: str, default: Column) -> Column:
        return F.coalesce(F.col(name).cast(kind), default) if name in sites.columns else default

    patterns = {
        name: given(name, "array<string>", F.array(*[F.lit(p) for p in getattr(options, name)]).cast("array<string>"))
        for name in ("include", "exclude")
    }
    return sites.select(
        "site",
        U.canonicalize(F.col("root_url")).alias("root_url"),
        given("max_pages", "int", F.lit(options.max_pages)).alias("max_pages"),
        given("max_depth", "int", F.lit(options.max_depth)).alias("max_depth"),
        given("same_host_only", "boolean", F.lit(options.same_host_only)).alias("same_host_only"),
        patterns["include"].alias("include"),
        patterns["exclude"].alias("exclude"),
    )


def with_site(df: DataFrame, sites: DataFrame, spread: str) -> DataFrame:
    """Attach per-site columns to rows of which one site may hold a large share.

    A counted, small ``sites`` table is broadcast. A larger one is joined on ``site`` and a salt of
    ``spread``, so that the rows of a dominant site are dealt to ``SALTS`` tasks.
    """
    if is_small(sites):
        return df.join(F.broadcast(sites), "site")
    copies = sites.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["site", "_salt"]).drop("_salt")


def success(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def captures_of_pages(pages: DataFrame, fetched_at: str = "2024-01-01 00:00:00") -> DataFrame:
    """A plain table ``(page_id, url, html)`` as successful HTML captures, one site per host."""
    return pages.select(
        F.col("page_id").alias("capture_id"),
        U.host(F.col("url")).alias("site"),
        "url",
        F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        F.col("html").alias("body"),
        F.lit(fetched_at).cast("timestamp").alias("fetched_at"),
        F.lit(PRIMARY).alias("channel"),
        F.lit(1).alias("attempt"),
    )
