"""Tolerant reads of JSON kept as variant values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import trim_ws


def json_type(value: Column, path: str) -> Column:
    """Type name at ``path`` (``STRING``, ``BOOLEAN``, ``OBJECT<...>``, ...); null when nothing is there."""
    return F.schema_of_variant(F.try_variant_get(value, path, "variant"))


def json_string(value: Column, path: str) -> Column:
    """The string at ``path``; null when absent or of another type."""
    return F.when(json_type(value, path) == "STRING", F.try_variant_get(value, path, "string"))


def json_nested_string(value: Column, path: str) -> Column:
    """Trimmed string at a nested path; empty when absent or of another type."""
    return F.coalesce(trim_ws(json_string(value, path)), F.lit(""))


def json_date_or(value: Column, path: str, fallback: Column) -> Column:
    """Timestamp at ``path``; ``fallback`` when absent or unreadable."""
    return F.coalesce(F.try_to_timestamp(json_string(value, path)), fallback)
