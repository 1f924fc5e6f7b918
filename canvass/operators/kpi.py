"""Key figures and chart series of the statistics page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.answers import has_answer
from canvass.functions.jsontext import is_list, string_only
from canvass.functions.scales import ASCENDING, half_up_1, rating
from canvass.functions.text import split_options_trimmed_tail, trim_controls
from canvass.operators.paging import PAGE_SIZE, nest_pages
from canvass.operators.ratings import RATINGS
from canvass.schemas import SPRING, TECHNOLOGIES


def _typed(surveys: DataFrame, key: str):
    """(text of a string answer, list answer) of a key; other kinds give NULL for both.

    Rows normalised from bodies keep JSON types in ``typed_answers``.  Elsewhere answers
    are text, in which a list is its JSON text.
    """
    if "typed_answers" in surveys.columns:
        value = F.col("typed_answers")[key]
        return string_only(value), F.when(
            is_list(value), F.try_variant_get(value, "$", "array<string>")
        )
    value = F.col(key) if key in surveys.columns else F.col("answers")[key]
    listed = F.when(value.startswith("["), F.from_json(value, "array<string>"))
    return F.when(listed.isNull(), value), listed


def _has(surveys: DataFrame, key: str):
    if "typed_answers" in surveys.columns:
        return F.map_contains_key("typed_answers", key)
    return has_answer(surveys, key)


def list_aware_votes(surveys: DataFrame) -> DataFrame:
    """Votes per option, where the answer is a list or a comma-separated text.

    Unlike ``tech_votes`` empty options at the end of a text are dropped, and control
    characters are trimmed like spaces.
    """
    text, listed = _typed(surveys, TECHNOLOGIES)
    options = F.coalesce(listed, split_options_trimmed_tail(text))
    return (
        surveys.filter(_has(surveys, TECHNOLOGIES))
        .select(F.explode(options).alias("option"))
        .groupBy(trim_controls(F.col("option")).alias("technology"))
        .agg(F.count("*").alias("votes"))
    )


def key_figures(surveys: DataFrame) -> DataFrame:
    """One row: responses, mean rating to one decimal, distinct sessions, rating counts.

    A missing session counts as one value, and without ratings the mean is 0.0, which
    also makes the row of an empty table all zeros.
    """
    text, _ = _typed(surveys, SPRING)
    scored = surveys.select(
        "sessionId",
        F.when(_has(surveys, SPRING), rating(text, ASCENDING)).alias("r"),
    )
    missing = F.coalesce(F.max(F.col("sessionId").isNull().cast("int")), F.lit(0))
    return scored.agg(
        F.count("*").alias("totalResponses"),
        half_up_1(F.coalesce(F.avg("r"), F.lit(0.0))).alias("avgRating"),
        (F.count_distinct("sessionId") + missing).alias("uniqueUsers"),
        *[F.count_if(F.col("r") == r).alias(f"ratings_{r}") for r in RATINGS[1:]],
    )


def chart_series(votes: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Parallel lists of labels and values, by label; one row per page of options."""
    pages = nest_pages(
        votes, by=[], key="technology", count="votes", sort=[F.col("technology")],
        name="bars", page_size=page_size,
    )
    return pages.select(
        F.lit("technologies").alias("chart"), "page",
        F.col("bars.technology").alias("labels"), F.col("bars.votes").alias("data"),
    )


def overview(surveys: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """The whole record: key figures, votes per technology, both charts.

    Technologies beyond one page give further rows, which repeat no key figures.  Without
    any vote the record still has its one row.
    """
    figures = key_figures(surveys).select(
        F.lit(0).alias("page"),
        F.struct("totalResponses", "avgRating", "uniqueUsers").alias("figures"),
        F.array(*[F.col(f"ratings_{r}") for r in RATINGS[1:]]).alias("ratings"),
    )
    series = chart_series(list_aware_votes(surveys), page_size).drop("chart")
    record = figures.unionByName(series, allowMissingColumns=True).groupBy("page").agg(
        *[F.any_value(c, ignoreNulls=True).alias(c) for c in ("figures", "ratings", "labels", "data")]
    )
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    data = F.coalesce("data", F.array().cast("array<bigint>"))
    return record.select(
        "page", "figures.*",
        F.map_from_arrays(labels, data).alias("techPopularity"),
        F.struct(
            F.array(*[F.lit(str(r)) for r in RATINGS[1:]]).alias("labels"), F.col("ratings").alias("data"),
        ).alias("ratingsChart"),
        F.struct(labels.alias("labels"), data.alias("data")).alias("technologiesChart"),
        F.current_timestamp().alias("lastUpdated"),
    )
