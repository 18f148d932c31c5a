"""Summaries of changed pages: requests out, responses in, or an injected function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import url as U
from corpusloom.functions.binding import let
from corpusloom.functions.jsonval import json_string, json_type
from corpusloom.functions.text import trim_ws

TEMPERATURE = 0.2

# Fixed value: the prompt every page is summarised with. {title}, {url} and {markdown} are filled in.
PROMPT = """You are generating an AI-friendly page summary in markdown.
Return markdown only. Do not add commentary outside markdown sections.
Do not invent details. If unknown, write "Not specified".
Please follow the structure below exactly, filling in each section based on the extracted content, making sure to translate everything to English.

Required structure:
# {title}

## TL;DR
- 2-4 bullets

## Key points
- 5-10 concrete bullets

## Useful context
- Content type: ...
- Location: ...
- Services/areas: ...
- Deliverables: ...
- Constraints/criteria: ...

## FAQ
- 5 to 8 Q/A pairs
Q: ...
A: ...

## Reference
- Source: {url}

Source title: {title}
Source URL: {url}

Extracted content to summarize:
{markdown}"""


def build_prompt(title: Column, url: Column, markdown: Column) -> Column:
    values = {"title": title, "url": url, "markdown": markdown}
    pieces = []
    rest = PROMPT
    while "{" in rest:
        text, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        pieces += [F.lit(text), values[name]]
    return F.concat(*pieces, F.lit(rest))


def build_requests(pages: DataFrame, model: str) -> DataFrame:
    """One request body per changed page, keyed by site, URL and content hash."""
    payload = F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            build_prompt(F.col("title"), F.col("url"), F.col("markdown")).alias("prompt"),
            F.lit(False).alias("stream"),
            F.lit(TEMPERATURE).alias("temperature"),
        )
    )
    return pages.select("site", "url", "content_hash", payload.alias("request"))


def response_text(envelope: Column) -> Column:
    """Trimmed text of a response envelope; empty for a null text, null when there is no text to read."""

    def text(value: Column) -> Column:
        return F.when(json_type(value, "$.response") == "VOID", F.lit("")).otherwise(
            trim_ws(json_string(value, "$.response"))
        )

    return let(F.try_parse_json(envelope), text)


def as_summaries(pages: DataFrame) -> DataFrame:
    """Summary rows of pages that carry their summary as ``markdown``."""
    named = pages.withColumn("file_name", U.stable_filename(F.col("url")))
    return named.select(
        "site",
        "url",
        "title",
        "markdown",
        "content_hash",
        "file_name",
        U.page_path(F.col("file_name")).alias("relative_output_path"),
        "fetched_at",
        "rank",
    )


def attach_responses(pages: DataFrame, responses: DataFrame) -> DataFrame:
    """Changed pages with the summary found for them; ``markdown`` is null where there is none.

    ``responses`` has ``(site, url, content_hash, body)``. Inference that is tried again may leave several answers to one
    request: the least text of those that are not empty counts, and an empty one only where there is no other.
    """
    texts = responses.select("site", "url", "content_hash", response_text(F.col("body")).alias("_text"))
    summary = F.coalesce(F.min(F.when(F.col("_text") != "", F.col("_text"))), F.min("_text"))
    answers = texts.groupBy("site", "url", "content_hash").agg(summary.alias("_summary"))
    joined = pages.join(answers, ["site", "url", "content_hash"], "left")
    return as_summaries(joined.withColumn("markdown", F.col("_summary")))


def summarize_pages(pages: DataFrame, summarize: Callable[[str, str, str], str]) -> DataFrame:
    """Summaries by an injected function ``(title, url, markdown) -> text``, run in Arrow batches.

    A page the function raises on gets a null summary and leaves the manifest untouched.
    """

    def one(title: str, url: str, markdown: str) -> str | None:
        try:
            return summarize(title, url, markdown).strip()
        except Exception:
            return None

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [one(*row) for row in zip(frame["title"], frame["url"], frame["markdown"])]
            yield frame.assign(markdown=pd.Series(texts, dtype=object, index=frame.index))

    return as_summaries(pages.mapInPandas(batches, pages.schema))
