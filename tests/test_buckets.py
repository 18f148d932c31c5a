"""Manifest versions in buckets: same rows, and joins that leave the stored side where it is."""

from pyspark.sql import functions as F

from corpusloom.operators.incremental import join_manifest, upsert_manifest
from corpusloom.sinks.buckets import bucket_count
from corpusloom.sinks.manifest import read_manifest, upsert_version, upserted, write_manifest
from corpusloom.sources.tables import MANIFEST

PAGES = 3000
BUCKETS = 6


def rows(spark, first, last, value):
    """A site that holds two thirds of the rows, and null titles."""
    site = F.when(F.col("id") % 3 == 0, F.concat(F.lit("s"), F.col("id") % 7)).otherwise(F.lit("hot"))
    url = F.concat(F.lit("https://h.x/it's/"), F.col("id").cast("string"))
    table = spark.range(first, last).select(
        site.alias("site"), url.alias("url"), F.lit(value).alias("content_hash"), F.lit("p").alias("relative_output_path"),
        F.lit("then").alias("last_generated_at"), F.lit(None).cast("string").alias("title"),
    )
    return spark.createDataFrame(table.collect(), MANIFEST)


def tables(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def stored_side_moves(frame):
    """Whether an exchange stands above the scan of a bucketed table."""
    open_exchange = []
    for line in plan(frame).splitlines():
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        open_exchange = [d for d in open_exchange if d < depth]
        if "Exchange" in line:
            open_exchange.append(depth)
        if "FileScan" in line and "Bucketed: true" in line:
            return bool(open_exchange)
    raise AssertionError(plan(frame))


def test_versions_keep_their_buckets(spark, tmp_path):
    path = f"{tmp_path}/it's a manifest"
    assert read_manifest(spark, path).count() == 0
    assert write_manifest(rows(spark, 0, PAGES, "a"), path, BUCKETS) == 1
    first = read_manifest(spark, path)
    changed = rows(spark, PAGES - 10, PAGES + 10, "b")
    want = tables(upsert_manifest(first, changed))
    assert upsert_version(changed, path) == 2
    assert bucket_count(spark, f"{path}/v=2") == BUCKETS
    assert tables(read_manifest(spark, path)) == want and len(want) == PAGES + 10
    assert write_manifest(changed, path) == 3 and bucket_count(spark, f"{path}/v=3") == BUCKETS
    assert tables(first) == tables(rows(spark, 0, PAGES, "a"))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("corpusloom_")]


def test_only_the_other_side_moves(spark, tmp_path):
    path = str(tmp_path / "manifest")
    write_manifest(rows(spark, 0, PAGES, "a"), path, BUCKETS)
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        joined = join_manifest(rows(spark, 5, 50, "A"), read_manifest(spark, path))
        assert not stored_side_moves(joined)
        assert joined.filter("is_hit").count() == 45
        assert not stored_side_moves(upserted(spark, rows(spark, 5, 50, "b"), path, BUCKETS))
    finally:
        spark.conf.set(setting, before)


def test_plain_version_becomes_bucketed(spark, tmp_path):
    path = str(tmp_path / "manifest")
    rows(spark, 0, 20, "a").write.parquet(f"{path}/v=1")
    assert upsert_version(rows(spark, 10, 30, "b"), path) == 2
    assert bucket_count(spark, f"{path}/v=2") and read_manifest(spark, path).count() == 30


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path / "manifest")
    empty = spark.createDataFrame([], MANIFEST)
    assert write_manifest(empty, path) == 1 and read_manifest(spark, path).count() == 0
    assert upsert_version(empty, path) == 2 and upsert_version(rows(spark, 0, 5, "a"), path) == 3
    assert read_manifest(spark, path).count() == 5
