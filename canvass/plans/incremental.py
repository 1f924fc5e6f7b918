"""Reports that cost only the days that changed.

Landed submissions lie in folders by day.  For each day the job keeps partial results (counted
cells, distinct people or their sketches, votes) with a record of the files they were
computed from.  A run reads only days whose files differ from their record, replaces their partials,
drops those of days that are gone, and makes the four tables from the partials.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canvass.operators import reports
from canvass.sinks import files
from canvass.sinks.tables import _listed, _save, overwrite, write_tables

DAY = "submitted_date"
#: Runs whose partials lie apart before they are stored together.
FOLD = 8


def day_files(spark: SparkSession, landed: str) -> dict[str, str]:
    """For each day folder a digest of its files' names, sizes and times."""
    days = [d for d in files.folders(spark, landed) if d.startswith(f"{DAY}=")]
    listed = {d.split("=", 1)[1]: files.listing(spark, f"{landed}/{d}") for d in days}
    return {d: hashlib.sha256(repr(found).encode()).hexdigest() for d, found in listed.items() if found}


def partials(rows: DataFrame, exact: bool) -> dict[str, DataFrame]:
    """What is kept of days, with the name of its folder's day in ``day``; people within a day are final, users by hour are not."""
    rows = rows.withColumn("day", F.coalesce(F.col(DAY).cast("string"), F.lit("")))
    kept = {"cells": reports.cells(rows, "day"), "trends": reports.tech_trends(rows, "day")}
    if not exact:
        return kept | {"sketches": reports.people_sketches(rows, "day")}
    date, hour = F.to_date("submittedAt").alias("date"), F.hour("submittedAt").alias("hour")
    counted = rows.groupBy("day", date).agg(F.count_distinct("userId").alias("users"), F.count_distinct("sessionId").alias("sessions"))
    return kept | {"people": counted, "users": rows.select("day", hour, "userId").distinct()}


def _people(stored: dict[str, DataFrame]) -> DataFrame:
    """The layout of ``distinct_people``."""
    if "sketches" in stored:
        return reports.people_from(stored["sketches"])
    days = stored["people"].select("date", F.lit(None).cast("int").alias("hour"), "users", "sessions", F.lit(1).alias("by_day"))
    hours = stored["users"].groupBy("hour").agg(F.count_distinct("userId").alias("users"))
    return days.unionByName(hours.select(F.lit(None).cast("date").alias("date"), "hour", "users", F.lit(None).cast("long").alias("sessions"), F.lit(0).alias("by_day")))


def _stored(spark: SparkSession, path: str, state: dict) -> dict[str, DataFrame]:
    """The partials of all days: of each part only the days that no later part replaced."""
    owners: dict[str, list[str]] = {}
    for day, record in state["days"].items():
        owners.setdefault(record["part"], []).append(day)

    def of(name: str, schema: dict) -> DataFrame:
        schema = StructType.fromJson(schema)
        parts = [spark.read.schema(schema).parquet(f"{path}/{part}/{name}").filter(F.col("day").isin(days)) for part, days in owners.items()]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)

    return {name: of(name, schema) for name, schema in state["schemas"].items()}


def _key(folder: str) -> str:
    return "" if folder == "__HIVE_DEFAULT_PARTITION__" else folder


def refresh_reports(spark: SparkSession, landed: str, out: str, exact: bool = True) -> dict[str, list[str]]:
    """Bring the four tables below ``out`` up to date with the folder of landed submissions.

    Returns the days that were read and those that are gone.  A day whose files are the same is not
    opened, whether others grew, shrank or went.  The tables become readable together; until then,
    and after a failed run, readers see the old ones.  ``exact=False`` keeps sketches in place of users,
    so the partials stay small however many people there are.  The result is that of ``write_reports``.
    """
    path, kind = f"{out}/days", "exact days" if exact else "sketched days"
    state = _listed(spark, path, kind)
    known, now = state.get("days", {}), day_files(spark, landed)
    changed = sorted(d for d in now if known.get(_key(d), {}).get("files") != now[d])
    gone = sorted(set(known) - {_key(d) for d in now})
    state["days"] = {d: r for d, r in known.items() if d not in gone}
    if changed:
        rows = spark.read.option("basePath", landed).parquet(*(f"{landed}/{DAY}={d}" for d in changed))
        _put(spark, path, state, partials(rows, exact))
        state["days"] |= {_key(d): {"files": now[d], "part": state["parts"][-1]} for d in changed}
    if len(state["parts"]) > FOLD:
        old = state["parts"]
        _put(spark, path, state, _stored(spark, path, state))
        state["parts"] = state["parts"][-1:]
        state["days"] = {d: r | {"part": state["parts"][0]} for d, r in state["days"].items()}
        state, retired = state | {"retired": old}, state.get("retired", [])
    else:
        retired = []
    if "schemas" not in state:
        raise ValueError(f"no submissions in {landed}")
    _save(spark, path, state)

    def tables(_: dict) -> dict:
        stored = _stored(spark, path, state)
        cells, people = stored["cells"].drop("day"), _people(stored)
        return {"cells": cells, "tech_trends": stored["trends"].drop("day"), "daily_stats": reports.daily_from(cells, people),
                "hourly_report": reports.hourly_from(cells, people), "correlations": reports.correlations_from(cells)}

    write_tables(spark, f"{out}/tables", tables)
    for part in retired:
        files.remove(spark, f"{path}/{part}")
    return {"read": [_key(d) for d in changed], "gone": gone}


def _put(spark: SparkSession, path: str, state: dict, stored: dict[str, DataFrame]) -> None:
    part = f"data/{uuid.uuid4().hex}"
    for name, df in stored.items():
        overwrite(df, f"{path}/{part}/{name}")
    state["parts"] = [*state["parts"], part]
    state["schemas"] = {name: df.schema.jsonValue() for name, df in stored.items()}
