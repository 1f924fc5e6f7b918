"""Expensive expressions that several others build on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, *keep: str | Column, **columns: Column) -> DataFrame:
    """Add columns whose values are computed a single time per row.

    The optimizer copies a projected expression into every expression and filter above it;
    a parsed document would be parsed again for each field.  It does not look through a
    generator, so the values are handed over by one.
    """
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*(keep or ("*",)), F.inline(F.array(values)))
