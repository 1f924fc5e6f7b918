"""Lookups in the survey table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.answers import answer


def by_survey(surveys: DataFrame, survey_id: str) -> DataFrame:
    return surveys.filter(F.col("surveyId") == survey_id)


def in_range(surveys: DataFrame, first, last) -> DataFrame:
    """Submitted between two times, both included.

    On a table partitioned by day the days are restricted too, so only their folders
    are read.
    """
    hits = surveys.filter(F.col("submittedAt").between(first, last))
    if "submitted_date" in surveys.columns:
        hits = hits.filter(F.col("submitted_date").between(
            F.to_date(F.lit(first).cast("timestamp")), F.to_date(F.lit(last).cast("timestamp"))
        ))
    return hits


def by_answer(surveys: DataFrame, survey_id: str, key: str, value: str) -> DataFrame:
    return by_survey(surveys, survey_id).filter(answer(surveys, key) == value)


def count_by_survey(surveys: DataFrame, survey_id: str) -> DataFrame:
    return by_survey(surveys, survey_id).agg(F.count("*").alias("responses"))


def analytics_projection(surveys: DataFrame) -> DataFrame:
    return surveys.select("answers", "submittedAt")
