"""Main content of pages as markdown."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.binding import once
from corpusloom.functions.markdown import main_markdown
from corpusloom.functions.text import clean_markdown, content_sha256
from corpusloom.operators.triage import FETCH_FAILED

MIN_MARKDOWN_CHARS = 50
SUCCESS = "Success"
SKIPPED = "ExtractionSkipped"

# Reasons given for skipped pages.
TOO_SHORT = "Extracted markdown too short (<50 chars)"
NO_CONTAINER = "No readable content block found"


def skip_reason(markdown: Column) -> Column:
    """Why a page with this cleaned markdown is skipped; null markdown means no container was found."""
    return F.when(markdown.isNull(), F.lit(NO_CONTAINER)).when(
        F.length(markdown) < MIN_MARKDOWN_CHARS, F.lit(TOO_SHORT)
    )


def extract_pages(pages: DataFrame, convert: Callable[[str], str | None] = main_markdown) -> DataFrame:
    """Replace ``html`` by the markdown of the main content, with outcome and content hash.

    Pages are parsed in Arrow batches where they lie, without a shuffle. ``convert`` returns markdown or
    None when the page has no container; a page it raises on becomes a ``FetchFailed`` row.
    """
    carried = [f for f in pages.schema.fields if f.name != "html"]
    schema = T.StructType([*carried, T.StructField("_raw", T.StringType()), T.StructField("_failed", T.BooleanType())])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw, failed = [], []
            for page in frame.pop("html"):
                try:
                    raw.append(convert(page or ""))
                    failed.append(False)
                except Exception:
                    raw.append(None)
                    failed.append(True)
            yield frame.assign(_raw=pd.Series(raw, dtype=object, index=frame.index), _failed=failed)

    parsed = pages.select(*[f.name for f in carried], "html").mapInPandas(batches, schema)
    cleaned = once(parsed, markdown=F.when(F.col("_raw").isNotNull(), clean_markdown(F.col("_raw"))))
    reason = F.when(~F.col("_failed"), skip_reason(F.col("markdown")))
    return (
        cleaned.withColumn("skip_reason", reason)
        .withColumns(
            {
                "is_skipped": F.col("skip_reason").isNotNull(),
                "outcome": F.when(F.col("_failed"), F.lit(FETCH_FAILED))
                .when(F.col("skip_reason").isNotNull(), F.lit(SKIPPED))
                .otherwise(F.lit(SUCCESS)),
                "content_hash": F.when(~F.col("_failed"), content_sha256(F.col("markdown"))),
            }
        )
        .drop("_raw", "_failed")
    )
