"""The batch job: four result tables, a run summary and a ledger entry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.operators import reports
from canvass.sinks.connectors import Writer
from canvass.sinks.ledger import recorded
from canvass.sinks.tables import append, read_tables, write_partitioned, write_tables
from canvass.sources.surveys import landing_frame

REPORTS = ("daily_stats", "tech_trends", "correlations", "hourly_report")


def land_surveys(surveys: DataFrame, path: str) -> DataFrame:
    """Store submissions in columns by day, and read them all back.

    Days that occur in ``surveys`` replace what was stored of them, other days stay.  Every
    answer is kept, the hot ones also as columns, so each report scans the two to four columns it
    needs, instead of decoding every document again.
    """
    write_partitioned(landing_frame(surveys), path, ["submitted_date"], "replace")
    return surveys.sparkSession.read.parquet(path)


def write_reports(surveys: DataFrame, out: str, exact: bool = True) -> None:
    """The four tables, from three passes over the submissions: cells, distinct people, trends.

    They become readable together, in one commit.  ``exact=False`` sketches the distinct counts.
    """

    def passes(_: dict) -> dict:
        return {"cells": reports.cells(surveys), "distinct_people": reports.distinct_people(surveys, exact),
                "tech_trends": reports.tech_trends(surveys)}

    def tables(stored: dict) -> dict:
        counted, people = stored["cells"], stored["distinct_people"]
        return {"daily_stats": reports.daily_from(counted, people), "hourly_report": reports.hourly_from(counted, people),
                "correlations": reports.correlations_from(counted)}

    write_tables(surveys.sparkSession, f"{out}/tables", passes, tables)


def read_reports(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """All tables of the newest complete run."""
    return read_tables(spark, f"{out}/tables")


def stored_summary(spark: SparkSession, out: str) -> DataFrame:
    """Summary of the stored tables; no report is computed a second time for it."""
    stored = read_reports(spark, out)
    return reports.run_summary(stored["daily_stats"], stored["hourly_report"], stored["correlations"])


def run_batch_report(surveys: DataFrame, out: str, land_to: str | None = None,
                     copy: Writer | None = None, exact: bool = True) -> dict:
    """Write everything below ``out``; give ``land_to`` for sources that are not columnar.

    ``copy`` takes the stored tables to a further store, without computing them again.
    """
    spark = surveys.sparkSession

    def job() -> dict:
        source = land_surveys(surveys, land_to) if land_to else surveys
        write_reports(source, out, exact)
        summary = stored_summary(spark, out)
        generated = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
        append(summary.select(generated.alias("generated_at"), "*"), f"{out}/survey_reports")
        if copy:
            for name in (*REPORTS, "survey_reports"):
                copy(spark.read.parquet(f"{out}/{name}") if name == "survey_reports" else read_reports(spark, out)[name], name)
        span = read_reports(spark, out)["cells"].agg(
            F.min("first_at").alias("start"), F.max("last_at").alias("end")).first()
        row = summary.first()
        return {
            "start": span["start"], "end": span["end"],
            "results": row.asDict(),
            "metrics": {"total_days": row["total_days"], "total_hours": row["total_hours"]},
        }

    return recorded(spark, f"{out}/spark_analytics", "trend", job, {"landed": bool(land_to)})
