"""The derived archive: a site is a host, and none of its documents lists all its pages."""

from pyspark.sql import functions as F

from corpusloom.checks import archive as A
from corpusloom.checks.queries import feed_urls


def test_documents_of_a_large_site_stay_small(spark, tmp_path):
    n = 400
    urls = F.concat(F.lit("https://hot.example.com/en/"), F.col("id").cast("string"))
    rows = spark.range(n).select(F.col("id").alias("page_id"), urls.alias("url"), F.lit("<title>t</title>").alias("html"))
    rows.write.parquet(f"{tmp_path}/pages.parquet")
    pages = A.site_pages(spark, str(tmp_path))
    blocks = A.page_blocks(pages)
    sizes = {r["block"]: len(r["entries"]) for r in blocks.collect()}
    assert sizes == {b: 2 * b + 1 for b in range(20)}
    ids = [e["page_id"] for r in blocks.orderBy("block").collect() for e in r["entries"]]
    assert ids == list(range(n))
    listed = F.size(F.split("body", "example.com/")) - 1
    assert A.site_docs(pages, blocks).agg(F.max(listed)).first()[0] <= 2 * 40 + 1
    own = A.captures(pages, blocks).filter("capture_id < 0")
    assert own.count() == 20 + 2 and own.agg(F.max(listed)).first()[0] <= 40


def test_one_site_for_each_host(spark):
    pages = A.site_pages(spark, "/root/testdata/sf0.01")
    sites = A.sites_of(pages)
    assert sites.count() == pages.select("host").distinct().count()
    assert {r[0] for r in sites.select("max_pages").distinct().collect()} == set(A.BUDGETS)


def test_pages_of_feeds_list_every_page(spark, tmp_path):
    n = 400
    urls = F.concat(F.lit("https://wx.example.com/en/"), F.col("id").cast("string"))
    rows = spark.range(n).select(F.col("id").alias("page_id"), urls.alias("url"), F.lit("<title>t</title>").alias("html"))
    rows.write.parquet(f"{tmp_path}/pages.parquet")
    found = feed_urls(spark, str(tmp_path)).orderBy("rank").collect()
    assert [r.url for r in found] == [f"https://wx.example.com/en/{i}" for i in range(n)]
    docs = A.feed_pages(A.page_blocks(A.site_pages(spark, str(tmp_path))))
    assert docs.agg(F.max(F.size(F.split("body", "example.com/")) - 1)).first()[0] <= 2 * 20
