"""Votes for the options of a multi-select answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.answers import answer
from canvass.functions.text import split_options
from canvass.schemas import TECHNOLOGIES


def tech_votes(surveys: DataFrame) -> DataFrame:
    """One row per chosen option and submission."""
    text = answer(surveys, TECHNOLOGIES)
    return (
        surveys.filter(text.isNotNull())
        .select(F.explode(split_options(text)).alias("technology"), "submittedAt")
        .select(F.trim("technology").alias("technology_clean"), "submittedAt")
    )


def tech_popularity(surveys: DataFrame, exact: bool = True) -> DataFrame:
    """Votes and distinct submission times per option.

    Exact distinct counts are not available on streams; there use ``exact=False`` or
    the partial counts below.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return tech_votes(surveys).groupBy("technology_clean").agg(
        F.count("*").alias("total_votes"),
        distinct("submittedAt").alias("unique_sessions"),
    )


def partial_popularity(surveys: DataFrame) -> DataFrame:
    """Votes per option and submission time: what one micro-batch adds."""
    return tech_votes(surveys).groupBy("technology_clean", "submittedAt").agg(
        F.count("*").alias("votes")
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partial counts of several micro-batches as those of one, the newest."""
    return partials.groupBy("technology_clean", "submittedAt").agg(
        F.sum("votes").alias("votes"), F.max("batch_id").alias("batch_id"))


def merge_popularity(partials: DataFrame) -> DataFrame:
    """The popularity table out of the partial counts of any number of micro-batches."""
    return partials.groupBy("technology_clean").agg(
        F.sum("votes").alias("total_votes"),
        F.count_distinct("submittedAt").alias("unique_sessions"),
    )
