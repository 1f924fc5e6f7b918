"""Access to single answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def answer(df: DataFrame, key: str) -> Column:
    """The answer to ``key``, NULL where it was not given.

    Landed tables keep the frequently used answers as columns of their own, which
    lets the scan read them alone and push ``IS NOT NULL`` down; other frames hold
    them in the ``answers`` map.
    """
    if key in df.columns:
        return F.col(key)
    return F.col("answers")[key]


def has_answer(df: DataFrame, key: str) -> Column:
    """Whether the key is there at all; in a map it may be there with a NULL value."""
    if key in df.columns:
        return F.col(key).isNotNull()
    return F.coalesce(F.map_contains_key("answers", key), F.lit(False))


def flatten_answers(df: DataFrame, keys) -> DataFrame:
    """Add one column per key, so that a columnar table can prune and filter them."""
    return df.withColumns({k: F.col("answers")[k] for k in keys if k not in df.columns})
