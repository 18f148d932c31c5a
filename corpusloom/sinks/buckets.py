"""Table versions in hash buckets of their key, so that joins on the key leave the stored rows where they are.

Spark keeps the buckets of a table in the catalog. A version is a folder, so its number of buckets is noted in the folder
and a table of passing name is laid over it when it is written or read; the catalog keeps nothing. A version without a
note is read as a plain folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_NOTE = "_buckets-"


def _passing_name() -> str:
    return f"corpusloom_{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def bucket_count(spark: SparkSession, path: str) -> int | None:
    """How many buckets the folder's rows are in; none if they are in no buckets."""
    folder, files = _folder(spark, path)
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(_NOTE):
            return int(name[len(_NOTE) :])
    return None


def read_buckets(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The rows of a folder. A join on ``keys`` reads them bucket by bucket and moves the other side only."""
    buckets = bucket_count(spark, path)
    if buckets is None:
        return spark.read.schema(schema).parquet(path)
    name, by = _passing_name(), ", ".join(f"`{k}`" for k in keys)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        return spark.table(name)  # resolved here: the folder, not the name, is what later plans hold
    finally:
        spark.sql(f"DROP TABLE {name}")


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], buckets: int, sort_by: Sequence[str] = ()) -> None:
    """Write rows to a new folder in ``buckets``, without moving them: give rows that are in buckets, or dealt to them.

    :func:`dealt` deals rows; others would leave a small file of each bucket in every task. With ``sort_by`` the rows of
    each file are in that order.
    """
    spark, name = df.sparkSession, _passing_name()
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *keys)
    (writer.sortBy(*sort_by) if sort_by else writer).mode("overwrite").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    folder, files = _folder(spark, path)
    files.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{_NOTE}{buckets}"))


def dealt(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Rows moved to the tasks of their buckets."""
    return df.repartition(buckets, *keys)
