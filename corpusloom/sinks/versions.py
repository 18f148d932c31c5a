"""Versioned table directories: a finished version is never changed, readers take the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def finished_versions(spark: SparkSession, path: str, prefix: str = "v=") -> list[int]:
    """Numbers of the complete versions below ``path``, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = []
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(prefix) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name[len(prefix) :]))
    return sorted(found)


def read_version(spark: SparkSession, path: str, schema: str, version: int | None = None, prefix: str = "v=") -> DataFrame:
    """A complete version, by default the newest; an empty table when there is none."""
    if version is None:
        done = finished_versions(spark, path, prefix)
        version = done[-1] if done else None
    if version is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{prefix}{version}")


def next_version(spark: SparkSession, path: str) -> int:
    done = finished_versions(spark, path)
    return done[-1] + 1 if done else 1
