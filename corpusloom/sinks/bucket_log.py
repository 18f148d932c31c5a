"""Keyed tables kept as steps in hash buckets, and the commits that say which steps count.

A step is one folder with a partition folder for every bucket in which it has rows. The newest row of a key counts. Work
on some keys reads the buckets of these keys only; compaction rewrites the buckets that were written since, and leaves
the others where they are. Nothing that a commit names is ever changed, so a batch that is run again reads what it read
before and writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.ranking import first_by_key
from corpusloom.sinks.versions import finished_versions

BATCH, SNAPSHOT = "batch=", "snapshot="
COMMIT = "log string, bucket int, buckets int, steps array<string>"

Pieces = dict[int, list[str]]


@dataclass(frozen=True)
class BucketLog:
    """A log below ``folder``: rows of ``schema``, one per ``keys`` and step, in buckets by the hash of ``spread``."""

    folder: str
    schema: str
    keys: tuple[str, ...]
    spread: tuple[str, ...]
    buckets: int

    @property
    def columns(self) -> list[str]:
        return T._parse_datatype_string(self.schema).fieldNames()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.spread), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Numbers of the buckets that rows belong to: at most ``buckets`` of them."""
        return sorted(r.bucket for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def append(self, rows: DataFrame, step: str) -> list[int]:
        """Writes rows as a step, replacing an earlier attempt, and returns the buckets it has rows in."""
        path = f"{self.folder}/{step}"
        # Rebalanced files: small buckets are written by one task, large ones by several.
        placed = rows.select(*self.columns).withColumn("bucket", self.bucket()).hint("rebalance", "bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(path)
        return _partition_values(rows.sparkSession, path, "bucket=")

    def steps(self, spark: SparkSession, steps: Sequence[str], touched: Iterable[int]) -> DataFrame:
        """All rows of some steps in the touched buckets, with the number of their ``step``."""
        found = None
        for prefix in (SNAPSHOT, BATCH):
            mine = [f"{self.folder}/{step}" for step in steps if step.startswith(prefix)]
            if mine:
                name = prefix[:-1]
                stored = spark.read.schema(f"{self.schema}, {name} int, bucket int").option("basePath", self.folder).parquet(*mine)
                part = stored.filter(F.col("bucket").isin(sorted(touched))).select(*self.columns, F.col(name).alias("step"))
                found = part if found is None else found.unionByName(part)
        return spark.createDataFrame([], f"{self.schema}, step int") if found is None else found

    def newest(self, spark: SparkSession, pieces: Mapping[int, Sequence[str]], touched: Iterable[int] | None = None) -> DataFrame:
        """The newest row of each key, of all buckets or of the touched ones."""
        wanted = pieces if touched is None else {b: pieces[b] for b in touched if b in pieces}
        folders = sorted({step for steps in wanted.values() for step in steps})
        rows = self.steps(spark, folders, wanted)
        if len(folders) < 2:
            return rows.drop("step")
        newest = rows.withColumn("_age", -F.col("step")).drop("step")
        return first_by_key(newest, self.keys, ["_age"]).select(*self.columns)

    def compacted(self, spark: SparkSession, pieces: Pieces, number: int) -> Pieces:
        """Writes every bucket that has steps beside a snapshot as part of a new one."""
        step = f"{SNAPSHOT}{number}"
        grown = [b for b, steps in pieces.items() if len(steps) > 1 or not steps[0].startswith(SNAPSHOT)]
        if not grown:
            return pieces
        return pieces | {b: [step] for b in self.append(self.newest(spark, pieces, grown), step)}


def with_step(pieces: Mapping[int, Sequence[str]], buckets: Iterable[int], step: str) -> Pieces:
    """The pieces after a step was written to some buckets."""
    return {**{b: list(steps) for b, steps in pieces.items()}, **{b: [*pieces.get(b, []), step] for b in buckets}}


def _partition_values(spark: SparkSession, path: str, prefix: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return sorted(int(name[len(prefix) :]) for name in names if name.startswith(prefix))


def stored_buckets(spark: SparkSession, folder: str) -> int | None:
    """The number of buckets that the last commit names; None before the first."""
    done = finished_versions(spark, folder, BATCH)
    row = spark.read.schema(COMMIT).parquet(f"{folder}/{BATCH}{done[-1]}").first() if done else None
    return row.buckets if row else None


def read_commit(spark: SparkSession, folder: str, before: int, buckets: int | None = None) -> dict[str, Pieces]:
    """Pieces of every log as of the last commit before a batch. The number of buckets of a state never changes."""
    done = [v for v in finished_versions(spark, folder, BATCH) if v < before]
    commit: dict[str, Pieces] = {}
    if done:
        for row in spark.read.schema(COMMIT).parquet(f"{folder}/{BATCH}{done[-1]}").collect():
            if buckets is not None and row.buckets != buckets:
                raise ValueError(f"this state has {row.buckets} buckets, not {buckets}")
            commit.setdefault(row.log, {})[row.bucket] = list(row.steps)
    return commit


def write_commit(spark: SparkSession, folder: str, batch: int, commit: Mapping[str, Pieces], buckets: int) -> None:
    """Makes a batch count: one row for each log and bucket, however many rows they hold."""
    rows = [(log, bucket, buckets, steps) for log, pieces in commit.items() for bucket, steps in pieces.items()]
    spark.createDataFrame(rows, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{BATCH}{batch}")
