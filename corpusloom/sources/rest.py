"""REST listings: detection, paging, item mapping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import url as U
from corpusloom.functions.binding import once
from corpusloom.functions.jsonval import json_date_or, json_nested_string, json_string, json_type
from corpusloom.functions.text import is_blank
from corpusloom.operators.merge import distinct_by_url, take_max_pages, widest_budget
from corpusloom.operators.ranking import first_n
from corpusloom.options import BuildOptions
from corpusloom.session import materialize
from corpusloom.sources.tables import success, with_site

# Probe endpoints in order, and the two collections in listing order.
PROBE_PATHS = ("/wp-json/", "/?rest_route=/")
COLLECTIONS = ("rest_pages", "rest_posts")
METHOD = "wordpress-rest"

# An item's place: collection, listing page, position in the page.
_COLLECTION = 1 << 60
_PAGE = 1 << 28


def _refused() -> Column:
    return F.coalesce(F.col("status").isin(401, 403), F.lit(False))


def _says_json(content_type: Column) -> Column:
    return F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("json"))


def rest_detect(site_docs: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per site: is a REST listing there, why not, and does a challenge block it.

    The probes are read in order until one decides: refusal says no, an index object says yes. A
    successful answer that is not JSON only leaves its challenge label behind.
    """
    probe = F.try_parse_json("body")
    has_key = F.lit(False)
    for key in ("routes", "namespace", "namespaces"):
        has_key = has_key | json_type(F.col("v"), f"$.{key}").isNotNull()
    ok, says_json = success(F.col("status")), _says_json(F.col("content_type"))
    verdict = F.when(_refused(), F.lit("refused")).when(
        ok & says_json & json_type(F.col("v"), "$").startswith("OBJECT") & has_key, F.lit("found")
    )
    label = F.when(_refused() | (ok & ~says_json), H.detect_challenge(F.col("body")))
    read = (
        site_docs.filter(F.col("kind") == "rest_probe")
        .withColumn("v", F.when(ok & says_json, probe))
        .select("site", "doc_url", "status", "candidate_ord", verdict.alias("verdict"), label.alias("label"))
    )
    folded = read.groupBy("site").agg(
        F.min_by(
            F.struct("verdict", "status", "doc_url", "candidate_ord"), F.when(F.col("verdict").isNotNull(), F.col("candidate_ord"))
        ).alias("d"),
        F.min_by(F.struct("label", "candidate_ord"), F.when(F.col("label").isNotNull(), F.col("candidate_ord"))).alias("c"),
    )
    seen = F.when(
        F.col("d.candidate_ord").isNull() | (F.col("c.candidate_ord") <= F.col("d.candidate_ord")), F.col("c.label")
    )
    refusal = F.concat(F.lit("HTTP "), F.col("d.status").cast("string"), F.lit(" from "), F.col("d.doc_url"))
    found = F.coalesce(F.col("d.verdict") == "found", F.lit(False))
    reason = (
        F.when(found, F.lit(None).cast("string"))
        .when(F.col("d.verdict") == "refused", F.coalesce(seen, refusal))
        .when(seen.isNotNull(), F.concat(F.lit("WP REST blocked by site protection: "), seen))
        .otherwise(F.lit("WP REST route not detected"))
    )
    return (
        sites.select("site")
        .join(folded, "site", "left")
        .select("site", found.alias("available"), reason.alias("reason"), (~found & seen.isNotNull()).alias("blocked_by_challenge"))
    )


def map_rest_items(entries: DataFrame, as_of: Column) -> DataFrame:
    """Items of exploded listing entries (``v`` variant), with unusable ones dropped.

    ``entries`` carries ``root_url`` and ``same_host_only``; all its other columns are kept.
    """
    v = F.col("v")
    link = json_string(v, "$.link")
    kept = entries.filter(
        json_type(v, "$").startswith("OBJECT")
        & (F.coalesce(F.lower(json_string(v, "$.type")), F.lit("")) != "attachment")
        & ~F.coalesce((json_type(v, "$.protected") == "BOOLEAN") & F.try_variant_get(v, "$.protected", "boolean"), F.lit(False))
        & ~is_blank(link)
    )
    kept = once(kept, url=U.canonicalize(link)).filter(
        F.col("url").isNotNull()
        & U.is_http(F.col("url"))
        & U.same_host(F.col("url"), F.col("root_url"), F.col("same_host_only"))
    )
    parts = once(
        kept,
        _title=json_nested_string(v, "$.title.rendered"),
        _content=json_nested_string(v, "$.content.rendered"),
        _excerpt=json_nested_string(v, "$.excerpt.rendered"),
        _described=json_nested_string(v, "$.yoast_head_json.og_description"),
        modified_at=json_date_or(v, "$.modified", as_of),
    ).drop("v")
    rendered = (
        F.when(F.col("_content") != "", F.col("_content"))
        .when(F.col("_excerpt") != "", F.col("_excerpt"))
        .when(F.col("_described") != "", H.html_encode_paragraph(F.col("_described")))
    )
    return (
        parts.filter((F.col("_content") != "") | (F.col("_excerpt") != "") | (F.col("_described") != ""))
        .withColumns(
            {
                "title": F.when(F.col("_title") == "", U.fallback_title(F.col("url"))).otherwise(F.col("_title")),
                "html": H.sanitize_html(rendered),
            }
        )
        .drop("_title", "_content", "_excerpt", "_described", "root_url", "same_host_only")
    )


@dataclass(frozen=True)
class RestListing:
    """Outcome of the REST strategy: the items kept and one status row per site."""

    items: DataFrame
    status: DataFrame

    @property
    def discovered(self) -> DataFrame:
        return self.items.select("site", "url", F.lit(METHOD).alias("discovery_method"), F.lit(0).alias("depth"), "ordinal")


def scan_rest_items(site_docs: DataFrame, sites: DataFrame, options: BuildOptions) -> RestListing:
    """Items of the pages collection, then of the posts collection, of every site with REST.

    Listing pages count from 1 up to the first one that is missing, unsuccessful, not JSON or empty, or
    to the announced last page. A refused listing request turns the whole strategy off for its site.
    """
    available = rest_detect(site_docs, sites).filter("available").select("site")
    options_of = sites.select("site", "root_url", "same_host_only", "max_pages").join(available, "site", "left_semi")
    options_of = materialize(options_of, "rest-sites")
    ok, says_json = success(F.col("status")), _says_json(F.col("content_type"))
    entries = F.when(ok & says_json, F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>"))
    docs = site_docs.filter(F.col("kind").isin(*COLLECTIONS)).select(
        "site",
        (F.col("kind") == COLLECTIONS[1]).cast("int").alias("collection"),
        "page_no",
        "total_pages",
        "status",
        entries.alias("entries"),
    )
    key = ["site", "collection"]
    requests = materialize(
        with_site(docs, options_of.select("site"), "page_no").select(
            *key, "page_no", "total_pages", "status", (F.coalesce(F.size("entries"), F.lit(0)) > 0).alias("good")
        ),
        "rest-requests",
    )
    good = requests.filter("good")
    follows = good.select(*key, (F.col("page_no") + 1).alias("page_no"), F.lit(True).alias("follows"))
    stray = F.when((F.col("page_no") > 1) & F.col("follows").isNull(), F.col("page_no"))
    final = F.when(F.col("page_no") >= F.col("total_pages"), F.col("page_no"))
    bounds = good.join(follows, [*key, "page_no"], "left").groupBy(*key).agg(F.min(stray).alias("gap"), F.min(final).alias("final"))
    in_chain = (F.col("gap").isNull() | (F.col("page_no") < F.col("gap"))) & (F.col("final").isNull() | (F.col("page_no") <= F.col("final")))
    chain = good.join(bounds, key).filter(in_chain).select(*key, "page_no", "final")

    listed = (
        with_site(docs.join(chain.select(*key, "page_no"), [*key, "page_no"], "left_semi"), options_of, "page_no")
        .select(*key, "page_no", "root_url", "same_host_only", F.posexplode("entries").alias("pos", "v"))
        .withColumn(
            "ordinal",
            F.col("collection") * F.lit(_COLLECTION) + F.col("page_no").cast("bigint") * F.lit(_PAGE) + F.col("pos"),
        )
        .drop("page_no", "pos")
    )
    items = materialize(map_rest_items(listed, F.lit(options.as_of).cast("timestamp")), "rest-items")

    # Per collection: items mapped, and whether the request after the last good page was refused.
    ends = chain.groupBy(*key).agg(F.max("page_no").alias("last"), (F.max("page_no") == F.max("final")).alias("complete"))
    mapped = items.groupBy(*key).agg(F.count("*").alias("n"))
    refusals = (
        requests.filter(_refused())
        .join(ends, key, "left")
        .filter((F.col("page_no") == F.coalesce("last", F.lit(0)) + 1) & ~F.coalesce("complete", F.lit(False)))
        .groupBy(*key)
        .agg(F.min("status").alias("refused"))
    )
    per_site = (
        mapped.join(refusals, key, "full")
        .groupBy("site")
        .agg(
            *[
                F.sum(F.when(F.col("collection") == i, F.col(c))).alias(f"{c}{i}")
                for i in (0, 1)
                for c in ("n", "refused")
            ]
        )
    )
    budget = F.col("max_pages")
    n_pages = F.least(F.coalesce("n0", F.lit(0)), budget)
    room = budget - n_pages
    pages_refused = F.col("refused0").isNotNull() & (F.coalesce("n0", F.lit(0)) < budget)
    posts_refused = F.col("refused1").isNotNull() & (F.coalesce("n1", F.lit(0)) < room)
    status = (
        options_of.select("site", "max_pages")
        .join(per_site, "site", "left")
        .select(
            "site",
            n_pages.cast("int").alias("pages_count"),
            F.when(pages_refused, F.lit(0)).otherwise(F.least(F.coalesce("n1", F.lit(0)), room)).cast("int").alias("posts_count"),
            (pages_refused | posts_refused).alias("disabled"),
            F.when(pages_refused, F.col("refused0")).when(posts_refused, F.col("refused1")).cast("int").alias("refused_status"),
        )
    )

    # Budgets are spent on narrow rows; the HTML joins the survivors.
    narrow = items.select(*key, "ordinal", "url")
    first = first_n(narrow, key, ["ordinal"], widest_budget(sites), "place")
    limits = status.filter("not disabled").select("site", "pages_count", "posts_count")
    within = F.col("place") <= F.when(F.col("collection") == 0, F.col("pages_count")).otherwise(F.col("posts_count"))
    kept = distinct_by_url(first.join(limits, "site").filter(within).select("site", "url", "ordinal"))
    chosen = take_max_pages(kept, sites).select("site", "ordinal")
    return RestListing(items.join(chosen, ["site", "ordinal"]).drop("collection"), status)
