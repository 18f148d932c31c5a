"""Rendered copies of sitemaps, feeds and REST answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions.text import is_blank
from corpusloom.session import broadcast_if_small, materialize
from corpusloom.sources.tables import PRIMARY, RENDERED, success

_KEY = ["site", "kind", "doc_url"]


def effective_docs(site_docs: DataFrame) -> DataFrame:
    """Documents as discovery reads them: the rendered copy where the plain answer failed or is a challenge page.

    Without a ``channel`` column all rows are plain. Only keys are compared; the bodies stay where they are read.
    """
    if "channel" not in site_docs.columns:
        return site_docs
    good = success(F.col("status")) & ~is_blank(F.col("body")) & ~H.is_challenge(F.col("body"))
    plain = site_docs.filter(F.col("channel") == PRIMARY)
    rendered = site_docs.filter((F.col("channel") == RENDERED) & good)
    failed = plain.filter(~good).select(*_KEY).distinct()
    replaced = broadcast_if_small(materialize(failed.join(rendered.select(*_KEY).distinct(), _KEY, "left_semi"), "replaced"))
    kept = plain.join(replaced, _KEY, "left_anti").unionByName(rendered.join(replaced, _KEY, "left_semi"))
    return kept.drop("channel")
