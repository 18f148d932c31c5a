"""Connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``component`` (the least id reachable) of every id in ``links`` (columns ``a`` and ``b``).

    Each round takes the least label among the neighbours and then the label of that label, so long chains shorten by
    half. Labels are read by joins on evenly spread ids; hubs are met by partial minima and by splits of skewed joins.
    A null end is ignored; no links give an empty result.
    """
    known = links.dropna()
    edges = materialize(known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("label")), "labels")
    while True:
        around = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = materialize(
            labels.join(around, F.col("id") == F.col("a")).select("id", F.col("label").alias("before"), F.least("label", "near").alias("label")), "lower"
        )
        far = lower.select(F.col("id").alias("label"), F.col("label").alias("far"))
        jumped = lower.join(far, "label").select("id", "before", F.least("label", "far").alias("label"))
        labels = materialize(jumped, "labels")
        if labels.filter("label < before").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.select("id", "label")
