"""First-N, first-by-key and exact ranks that stay balanced when one site dominates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialize

SALTS = 32
WIDE = 10_000
"""The largest ``n`` for which :func:`first_n` ranks within tasks."""


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is first by ``order``. Partially aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if rest == list(order) and len(rest) == 1:
        return df.groupBy(*keys).agg(F.min(rest[0]).alias(rest[0]))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return picked.select(*keys, "_first.*")


def first_n(df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group with their rank from 1.

    Ranks twice: within salted slices of the group, then over the at most ``SALTS * n`` survivors.
    Spark prunes both windows on the map side, so a group that holds a third of all rows never
    meets in one task. Beyond ``WIDE`` rows a group, where the survivors of one would be too many for a
    task, all rows are numbered by :func:`ordered_rank`. ``order`` must be unique within a group.
    """
    if n > WIDE:
        grouped = df.withColumn("_group", F.struct(*group))
        ranked = ordered_rank(grouped, ["_group"], [F.col(c) for c in order], rank).drop("_group")
        return ranked.filter(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("int"))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    slices = Window.partitionBy(*group, "_salt").orderBy(*order)
    survivors = salted.withColumn("_rn", F.row_number().over(slices)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    whole = Window.partitionBy(*group).orderBy(*order)
    return survivors.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n)


def ordered_rank(df: DataFrame, group: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """Exact rank of *every* row within its group, without ever sorting a group in one task.

    Rows are range-partitioned by group and order and numbered where they lie; what each partition
    holds of a group is counted, and a running sum of those counts shifts the numbers. Pass narrow
    rows: they are written to scratch once. ``order`` must be unique within a group.
    """
    keys = [F.col(c) for c in group]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    stored = materialize(placed.withColumn("_id", F.monotonically_increasing_id()), "rank")
    stored = stored.withColumn("_part", F.shiftright("_id", 33))
    runs = stored.groupBy(*group, "_part").agg(F.min("_id").alias("_start"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(*group, "_part", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        stored.join(shifts, [*group, "_part"])
        .withColumn(rank, F.col("_before") + F.col("_id") - F.col("_start") + 1)
        .drop("_part", "_start", "_before", "_id")
    )
