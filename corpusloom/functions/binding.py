"""Small devices for composing column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed a single time however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def each(values: Column, sql_lambda: str) -> Column:
    """``transform`` with the function given as SQL text, such as ``x -> upper(x)``.

    The text is parsed once on the JVM side, which keeps long expressions cheap to build.
    """
    return F.call_function("transform", values, F.expr(sql_lambda))


def apply(value: Column, sql_lambda: str) -> Column:
    """One value through a SQL function text; the value is computed a single time."""
    return F.element_at(each(F.array(value), sql_lambda), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later filters and joins use.

    The optimizer moves a filter below the projection that computes its column, by computing the column
    a second time. It does not move one below a generator, so the columns come out of one.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))
