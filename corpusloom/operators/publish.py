"""Documents and index lines of a finished corpus, as tables.

Line tables have ``(site, section, fold, rank, line)``: sorting a site by the middle three gives its file.
Order is kept as columns, so no site is ever gathered to be put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.functions.text import build_frontmatter, iso_instant, ordinal_fold, trim_ws
from corpusloom.operators.ranking import first_by_key, ordered_rank
from corpusloom.options import BuildOptions
from corpusloom.session import broadcast_if_small, materialize
from corpusloom.sources.tables import with_site

LINE_ORDER = ("section", "fold", "rank")

# File names and headings of the published files (their further header lines are below).
INDEX_FILE = "llms.txt"
FULL_FILE = "llms-full.txt"
INDEX_HEADING = "## Index"
PAGES_HEADING = "## Pages"


def dedupe_by_filename(summaries: DataFrame) -> DataFrame:
    """One page per file name ignoring case: the one of lowest rank, and of equal ranks the first by URL.

    Only names are grouped. The superseded pages, few as a rule, are stored and counted, so that the
    bodies meet them in a broadcast anti join.
    """
    names = summaries.select("site", F.lower("file_name").alias("name"), F.struct("rank", "url").alias("place"))
    firsts = names.groupBy("site", "name").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = names.join(firsts, ["site", "name"]).filter(F.col("place") > F.col("first")).select("site", "place.url", "place.rank")
    later = broadcast_if_small(materialize(later, "superseded"))
    return summaries.join(later, ["site", "url", "rank"], "left_anti")


def detect_collision(summaries: DataFrame, previous: DataFrame) -> DataFrame:
    """Narrow rows ``(site, url, file_name, claimed_by, collides)``.

    A file belongs to the URL an earlier run wrote it for, else to the first page of this run that
    writes it. Any other URL with that file name fails.
    """
    names = summaries.select("site", "file_name", "url", "rank")
    first = first_by_key(names, ["site", "file_name"], ["rank"]).select("site", "file_name", F.col("url").alias("first_url"))
    earlier = previous.groupBy("site", "file_name").agg(F.min("url").alias("earlier_url"))
    return (
        names.join(first, ["site", "file_name"])
        .join(earlier, ["site", "file_name"], "left")
        .withColumn("claimed_by", F.coalesce("earlier_url", "first_url"))
        .select("site", "url", "file_name", "claimed_by", (F.col("claimed_by") != F.col("url")).alias("collides"))
    )


def page_files(summaries: DataFrame, generator: str) -> DataFrame:
    """Path and content of every page file: front matter and the summary."""
    head = build_frontmatter(F.col("title"), F.col("url"), F.col("fetched_at"), F.col("content_hash"), generator)
    return summaries.select(
        "site",
        "url",
        F.concat(U.site_folder(F.col("site")), F.lit("/"), F.col("relative_output_path")).alias("path"),
        "relative_output_path",
        F.concat(head, F.lit("\n"), trim_ws(F.col("markdown")), F.lit("\n")).alias("content"),
    )


def _fixed_lines(sites: DataFrame, section: int, lines: list[Column]) -> DataFrame:
    return sites.select("site", F.posexplode(F.array(*lines)).alias("pos", "line")).select(
        "site",
        F.lit(section).alias("section"),
        F.lit("").alias("fold"),
        F.col("pos").cast("bigint").alias("rank"),
        "line",
    )


def _entries(summaries: DataFrame, sites: DataFrame, path: Column) -> DataFrame:
    roots = sites.select("site", U.authority_prefix(F.col("root_url")).alias("prefix"))
    named = summaries.select("site", "title", "rank", path.alias("path"))
    return with_site(named, roots, "rank").select(
        "site",
        F.lit(1).alias("section"),
        ordinal_fold(F.col("title")).alias("fold"),
        F.col("rank").cast("bigint").alias("rank"),
        F.concat(F.lit("- "), F.col("title"), F.lit(": "), F.col("prefix"), F.lit("/"), F.col("path")).alias("line"),
    )


def index_lines(summaries: DataFrame, sites: DataFrame, options: BuildOptions) -> DataFrame:
    """Lines of the per-site index file, pages by title ignoring case and then by rank."""
    host = U.host(F.col("root_url"))
    header = _fixed_lines(
        sites,
        0,
        [
            F.concat(F.lit(f"# {INDEX_FILE} for "), host),
            F.lit(""),
            F.concat(F.lit("Site root: "), F.col("root_url")),
            F.lit(f"Short description: AI-friendly markdown summaries generated by {options.generator}."),
            F.lit(""),
            F.lit(INDEX_HEADING),
        ],
    )
    return header.unionByName(_entries(summaries, sites, U.page_path(F.col("file_name"))))


def page_counts(summaries: DataFrame, sites: DataFrame) -> DataFrame:
    """Sites with the number of pages included."""
    counts = summaries.groupBy("site").agg(F.count("*").alias("page_count"))
    return sites.join(counts, "site", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))


def full_lines(summaries: DataFrame, sites: DataFrame, options: BuildOptions) -> DataFrame:
    """Index and page blocks of the full-corpus file; a page block is one multi-line entry."""
    header = _fixed_lines(
        page_counts(summaries, sites),
        0,
        [
            F.concat(F.lit(f"# {FULL_FILE} for "), U.host(F.col("root_url"))),
            F.lit(""),
            F.concat(F.lit("Site root: "), F.col("root_url")),
            F.lit(f"Description: Full AI-friendly corpus generated by {options.generator}."),
            F.concat(F.lit("Generated at (UTC): "), iso_instant(F.lit(options.as_of).cast("timestamp"))),
            F.concat(F.lit("Pages included: "), F.col("page_count").cast("string")),
            F.lit(""),
            F.lit(INDEX_HEADING),
        ],
    )
    middle = _fixed_lines(sites, 2, [F.lit(""), F.lit(PAGES_HEADING), F.lit("")])
    path = F.replace(F.col("relative_output_path"), F.lit("\\"), F.lit("/"))
    block = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("Title: "), F.col("title")),
        F.concat(F.lit("URL: "), F.col("url")),
        F.concat(F.lit("Content Hash: "), F.col("content_hash")),
        F.concat(F.lit("Relative Output Path: "), F.col("relative_output_path")),
        F.lit(""),
        trim_ws(F.col("markdown")),
        F.lit(""),
    )
    blocks = summaries.select(
        "site",
        F.lit(3).alias("section"),
        ordinal_fold(F.col("title")).alias("fold"),
        F.col("rank").cast("bigint").alias("rank"),
        block.alias("line"),
    )
    return header.unionByName(_entries(summaries, sites, path)).unionByName(middle).unionByName(blocks)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``(site, section, ord, line)`` with ``ord`` counting the entries of a site's file from 1.

    The numbers are found on narrow rows; the text joins them on the entry's own key.
    """
    places = ordered_rank(lines.select("site", *LINE_ORDER), ["site"], [F.col(c) for c in LINE_ORDER], "ord")
    return lines.join(places, ["site", *LINE_ORDER]).select("site", "section", "ord", "line")


def file_parts(
    numbered: DataFrame, file_name: str, entries_per_file: int, head: str = "", between: str = "\n", tail: str = "\n"
) -> DataFrame:
    """``(path, content)`` of the published files, each ``head``, its entries, and ``tail``.

    A site with more entries than ``entries_per_file`` gets consecutive parts ``.part-00001`` and so on,
    so no group is larger than that however large a site is.
    """
    part = F.floor((F.col("ord") - 1) / entries_per_file)
    grouped = (
        numbered.withColumn("part", part)
        .groupBy("site", "part")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("entries"))
    )
    text = F.concat(F.lit(head), F.array_join(F.transform("entries", lambda e: e["line"]), between), F.lit(tail))
    suffix = F.when(F.col("part") == 0, F.lit("")).otherwise(
        F.format_string(".part-%05d", F.col("part"))
    )
    path = F.concat(U.site_folder(F.col("site")), F.lit(f"/{file_name}"), suffix)
    return grouped.select(path.alias("path"), text.alias("content"))
