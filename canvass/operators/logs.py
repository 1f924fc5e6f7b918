"""Log documents: building, routing and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.text import matches_any

NO_MESSAGE = "Brak wiadomości"


def submission_log(surveys: DataFrame) -> DataFrame:
    """One INFO entry per stored submission."""
    return surveys.select(
        F.current_timestamp().alias("@timestamp"),
        F.lit("INFO").alias("level"),
        F.lit("SurveyController").alias("logger"),
        F.concat(F.lit("Survey submitted: "), F.coalesce("surveyId", F.lit("null"))).alias("message"),
        "surveyId", "userId", "sessionId",
        F.size("answers").alias("responseCount"),
        F.lit("spring-boot").alias("source"),
    )


def audit_events(surveys: DataFrame) -> DataFrame:
    """One audit document per submission, its answers as JSON text."""
    return surveys.select(
        F.lit("survey_event").alias("type"),
        "surveyId", "userId", "sessionId", "submittedAt",
        F.to_json("answers").alias("answers_json"),
        F.current_timestamp().alias("@timestamp"),
    )


def normalise_time(logs: DataFrame, ingested: str = "ingested_at") -> DataFrame:
    """ISO-8601 ``timestamp`` as ``@timestamp``; unreadable or missing ones get the ingest time."""
    return logs.withColumn(
        "@timestamp",
        F.coalesce(F.try_to_timestamp("timestamp"), F.col(ingested).cast("timestamp")),
    ).drop("timestamp")


def route_index(logs: DataFrame, time: str = "@timestamp") -> DataFrame:
    """Add the index a document goes to: a name by type, and the day."""
    return logs.withColumns({
        "index_name": F.when(F.col("type") == "survey", "surveys")
        .when(F.col("type") == "spark", "spark")
        .otherwise("logs"),
        "index_date": F.to_date(F.col(f"`{time}`")),
    })


def index_label(logs: DataFrame) -> DataFrame:
    """Add the full index name, such as ``logs-2024.01.31``."""
    return logs.withColumn(
        "index", F.concat_ws("-", "index_name", F.date_format("index_date", "yyyy.MM.dd"))
    )


def search_logs(logs: DataFrame, query: str = "", size: int = 10, message: str = "message",
                newest: tuple[str, ...] = ("@timestamp",)) -> DataFrame:
    """The newest matching documents.  Each task keeps its best ``size`` rows only.

    Further columns in ``newest`` settle ties.
    """
    hits = logs.filter(matches_any(F.col(message), query))
    return hits.orderBy(*[F.col(f"`{c}`").desc() for c in newest]).limit(size)


def display_defaults(logs: DataFrame) -> DataFrame:
    """Text for empty messages and the present for missing times."""
    return logs.withColumns({
        "message": F.coalesce(F.nullif("message", F.lit("")), F.lit(NO_MESSAGE)),
        "@timestamp": F.coalesce("@timestamp", F.current_timestamp()),
    })
