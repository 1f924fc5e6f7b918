"""Record of analysis runs."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.schemas import ANALYSIS_RUN, RUN_STATUS
from canvass.sinks.tables import append


def _texts(values: dict | None) -> dict:
    return {k: None if v is None else str(v) for k, v in (values or {}).items()}


def run_entry(spark: SparkSession, analysis_type: str, status: str, *, start=None, end=None,
              results=None, metrics=None, parameters=None, job_id: str | None = None) -> DataFrame:
    if status not in RUN_STATUS:
        raise ValueError(f"unknown status {status!r}")
    row = (
        analysis_type, dt.datetime.now(dt.timezone.utc), start, end,
        _texts(results),
        {k: None if v is None else float(v) for k, v in (metrics or {}).items()},
        _texts(parameters),
        job_id or uuid.uuid4().hex, spark.sparkContext.applicationId, status,
    )
    return spark.createDataFrame([row], ANALYSIS_RUN)


def recorded(spark: SparkSession, ledger: str, analysis_type: str, job: Callable[[], dict],
             parameters: dict | None = None) -> dict:
    """Run a job, and append that it began and how it ended.

    A run whose driver was lost stays PROCESSING.  The job returns the keyword arguments of ``run_entry`` that describe its outcome.
    """
    job_id = uuid.uuid4().hex
    started = dt.datetime.now()
    append(run_entry(spark, analysis_type, "PROCESSING", parameters=parameters, job_id=job_id), ledger)
    try:
        outcome = job()
    except Exception as error:
        append(run_entry(spark, analysis_type, "FAILED", results={"error": type(error).__name__},
                         parameters=parameters, job_id=job_id), ledger)
        raise
    outcome.setdefault("metrics", {})["seconds"] = (dt.datetime.now() - started).total_seconds()
    append(run_entry(spark, analysis_type, "COMPLETED", parameters=parameters, job_id=job_id, **outcome), ledger)
    return outcome


def current_states(runs: DataFrame) -> DataFrame:
    """The newest entry of each run."""
    names = runs.columns
    return runs.groupBy("sparkJobId").agg(F.max_by(F.struct(*names), "timestamp").alias("r")).select("r.*")


def latest_runs(runs: DataFrame, analysis_type: str, count: int = 10) -> DataFrame:
    """The newest runs of one kind, each in its newest state."""
    return (
        current_states(runs).filter(F.col("analysisType") == analysis_type)
        .filter(F.col("status").isin(*RUN_STATUS))
        .orderBy(F.desc("timestamp"), "sparkJobId").limit(count)
    )
