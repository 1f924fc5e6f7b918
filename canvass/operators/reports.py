"""Daily, hourly and trend reports over submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.answers import answer
from canvass.functions.scales import ASCENDING, DESCENDING, TOP_TWO, rating, usefulness
from canvass.functions.stats import pearson
from canvass.functions.text import split_options
from canvass.schemas import ELK, INTEGRATION, SPRING, TECHNOLOGIES

__all__ = ["ASCENDING", "DESCENDING", "TOP_TWO", "daily_stats", "hourly_report", "tech_trends",
           "answer_correlations", "run_summary", "newest_first"]


def daily_stats(surveys: DataFrame, exact: bool = True) -> DataFrame:
    """Per day: submissions, distinct users and sessions, mean rating (missing counts as 0).

    The distinct counts are first reduced per (day, user) and (day, session), so a day
    that holds most of the rows is spread over many tasks.  ``exact=False`` trades them
    for sketches, which need one shuffle of one row per day and task.
    """
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return (
        surveys.groupBy(F.to_date("submittedAt").alias("date"))
        .agg(
            F.count("*").alias("total_submissions"),
            distinct("userId").alias("unique_users"),
            distinct("sessionId").alias("unique_sessions"),
            F.avg(rating(answer(surveys, SPRING), DESCENDING)).alias("avg_rating"),
        )
    )


def hourly_report(surveys: DataFrame, exact: bool = True) -> DataFrame:
    """Per hour of the day over all days; everything but 4 and 5 rates as 3."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    return (
        surveys.groupBy(F.hour("submittedAt").alias("hour"))
        .agg(
            F.count("*").alias("submissions"),
            distinct("userId").alias("users"),
            F.avg(rating(answer(surveys, SPRING), TOP_TWO)).alias("avg_rating"),
        )
    )


def tech_trends(surveys: DataFrame, *keys: str) -> DataFrame:
    """Votes per day and option of the multi-select answer, and by further keys; empty options count too."""
    text = answer(surveys, TECHNOLOGIES)
    return (
        surveys.filter(text.isNotNull())
        .select(*keys, F.to_date("submittedAt").alias("date"), F.explode(split_options(text)).alias("technology"))
        .groupBy(*keys, "date", F.trim("technology").alias("technology_clean"))
        .agg(F.count("*").alias("daily_votes"))
    )


def answer_correlations(surveys: DataFrame, match: str = "contains") -> DataFrame:
    """One row with the pairwise correlations of the two ratings and the usefulness score."""
    scores = surveys.select(
        rating(answer(surveys, SPRING), DESCENDING).alias("spring"),
        rating(answer(surveys, INTEGRATION), DESCENDING).alias("integration"),
        usefulness(answer(surveys, ELK), match).alias("elk"),
    )
    # every score has a default, so there are no incomplete rows to leave out
    return scores.agg(
        pearson("spring", "integration").alias("spring_integration_corr"),
        pearson("spring", "elk").alias("spring_elk_corr"),
        pearson("integration", "elk").alias("integration_elk_corr"),
    )


def cells(surveys: DataFrame, *keys: str) -> DataFrame:
    """Submissions counted by day, hour and the scores of their answers, with their span, and by further keys.

    Few rows, from which counts, means and correlations follow without the submissions.
    """
    spring = answer(surveys, SPRING)
    scored = surveys.select(
        *keys, F.to_date("submittedAt").alias("date"), F.hour("submittedAt").alias("hour"),
        rating(spring, DESCENDING).alias("spring"), rating(spring, TOP_TWO).alias("top_two"),
        rating(answer(surveys, INTEGRATION), DESCENDING).alias("integration"),
        usefulness(answer(surveys, ELK), "contains").alias("elk"),
        F.col("submittedAt").cast("timestamp").alias("at"),
    )
    return scored.groupBy(*keys, "date", "hour", "spring", "top_two", "integration", "elk").agg(
        F.count("*").alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def distinct_people(surveys: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct users and sessions per day, and per hour of the day, in one pass."""
    distinct = F.count_distinct if exact else F.approx_count_distinct
    timed = surveys.select(
        F.to_date("submittedAt").alias("date"), F.hour("submittedAt").alias("hour"), "userId", "sessionId")
    sets = timed.groupingSets([["date"], ["hour"]], "date", "hour")
    return sets.agg(distinct("userId").alias("users"), distinct("sessionId").alias("sessions"), F.grouping("hour").alias("by_day"))


#: Base-two logarithm of the sketches' size: a relative standard error of 1.04 / sqrt(2**14), below one per cent.
SKETCH = 14


def people_sketches(surveys: DataFrame, *keys: str) -> DataFrame:
    """Users and sessions of each day and hour as sketches, which any span of days can add up."""
    timed = surveys.select(*keys, F.to_date("submittedAt").alias("date"), F.hour("submittedAt").alias("hour"), "userId", "sessionId")
    return timed.groupBy(*keys, "date", "hour").agg(
        F.hll_sketch_agg("userId", SKETCH).alias("users"), F.hll_sketch_agg("sessionId", SKETCH).alias("sessions"))


def people_from(sketches: DataFrame) -> DataFrame:
    """Estimated distinct people in the layout of ``distinct_people``, from sketches alone."""
    merged = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("users", "sessions")]
    days = sketches.groupBy("date").agg(*merged).withColumns({"hour": F.lit(None).cast("int"), "by_day": F.lit(1)})
    hours = sketches.groupBy("hour").agg(*merged).withColumns({"date": F.lit(None).cast("date"), "by_day": F.lit(0)})
    return days.unionByName(hours)


def _mean(score: str):
    return (F.sum(F.col("n") * F.col(score)) / F.sum("n")).alias("avg_rating")


def daily_from(counted: DataFrame, people: DataFrame) -> DataFrame:
    """``daily_stats`` from cells and distinct people."""
    days = people.filter("by_day = 1").select(F.col("date").alias("d"), "users", "sessions")
    totals = counted.groupBy("date").agg(F.sum("n").alias("total_submissions"), _mean("spring"))
    return totals.join(days, F.col("date").eqNullSafe(F.col("d"))).select(
        "date", "total_submissions", F.col("users").alias("unique_users"), F.col("sessions").alias("unique_sessions"), "avg_rating")


def hourly_from(counted: DataFrame, people: DataFrame) -> DataFrame:
    """``hourly_report`` from cells and distinct people."""
    hours = people.filter("by_day = 0").select(F.col("hour").alias("h"), "users")
    totals = counted.groupBy("hour").agg(F.sum("n").alias("submissions"), _mean("top_two"))
    return totals.join(hours, F.col("hour").eqNullSafe(F.col("h"))).select("hour", "submissions", "users", "avg_rating")


def correlations_from(counted: DataFrame) -> DataFrame:
    """``answer_correlations`` from cells."""
    return counted.agg(
        pearson("spring", "integration", "n").alias("spring_integration_corr"),
        pearson("spring", "elk", "n").alias("spring_elk_corr"),
        pearson("integration", "elk", "n").alias("integration_elk_corr"),
    )


def run_summary(daily: DataFrame, hourly: DataFrame, correlations: DataFrame) -> DataFrame:
    """One row about a finished run: days, hours, rating correlation (NULL stays NULL)."""
    parts = (
        daily.select(F.lit(1).alias("d"), F.lit(0).alias("h"), F.lit(None).cast("double").alias("c"))
        .unionAll(hourly.select(F.lit(0), F.lit(1), F.lit(None).cast("double")))
        .unionAll(correlations.select(F.lit(0), F.lit(0), F.col("spring_integration_corr")))
    )
    return parts.agg(
        F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("total_days"),
        F.coalesce(F.sum("h"), F.lit(0)).cast("bigint").alias("total_hours"),
        F.max("c").alias("avg_correlation"),
    )


def newest_first(report: DataFrame) -> DataFrame:
    """Reading order of a result table; tables are stored unsorted."""
    if "daily_votes" in report.columns:
        return report.orderBy(F.desc("date"), F.desc("daily_votes"), "technology_clean")
    if "date" in report.columns:
        return report.orderBy(F.desc("date"))
    if "total_votes" in report.columns:
        return report.orderBy(F.desc("total_votes"), "technology_clean")
    return report.orderBy("hour")
