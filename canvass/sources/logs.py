"""Log events."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.operators.logs import search_logs
from canvass.operators.token_index import hits_by_day
from canvass.sinks import files

#: The folder of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def union_intake(*inputs: DataFrame) -> DataFrame:
    """One stream or table out of several inputs whose columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), inputs)


@dataclass(frozen=True)
class Input:
    """A stream with its event time and how late its rows may come."""

    rows: DataFrame
    time: str
    delay: str


def union_streams(*inputs: Input, wait_for_slowest: bool = True) -> DataFrame:
    """One stream of several, with the event time of each as ``event_time`` and a watermark of each input's own delay.

    The watermark of the whole follows the slowest input, so nothing of an input that stalls is late when it
    comes, but windows stay open until it goes on.  Without ``wait_for_slowest`` it follows the fastest: windows close in
    time, and what a slow input brings for them later is dropped.  The choice holds for the session.
    """
    spark = inputs[0].rows.sparkSession
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min" if wait_for_slowest else "max")
    marked = [i.rows.withColumn("event_time", F.col(i.time).cast("timestamp")).withWatermark("event_time", i.delay) for i in inputs]
    return union_intake(*marked)


def read_log_index(spark: SparkSession, root: str, pattern: str = "logs*",
                   first_day=None, last_day=None) -> DataFrame:
    """Log documents of the indices that match a pattern, for example ``logs*``.

    Indices are partition folders ``index_name=<name>/index_date=<day>``; the pattern
    and the days prune them before any file is opened.
    """
    like = F.col("index_name").like(pattern.replace("_", r"\_").replace("*", "%"))
    logs = spark.read.parquet(root).filter(like)
    if first_day is not None:
        logs = logs.filter(F.col("index_date") >= F.lit(first_day).cast("date"))
    if last_day is not None:
        logs = logs.filter(F.col("index_date") <= F.lit(last_day).cast("date"))
    return logs


def days_of(spark: SparkSession, root: str, pattern: str = "logs*", first_day=None, last_day=None) -> list[date | None]:
    """The days of the indices that match a pattern, newest first, from the folders' names; None stands for rows without a day."""
    prefix = pattern.split("*")[0]
    names = [n for n in files.folders(spark, root) if n.startswith("index_name=")]
    if "*" not in pattern:
        names = [n for n in names if n == f"index_name={pattern}"]
    found = {d.split("=", 1)[1] for n in names if n.removeprefix("index_name=").startswith(prefix)
             for d in files.folders(spark, f"{root}/{n}") if d.startswith("index_date=")}
    days = sorted((date.fromisoformat(d) for d in found - {NO_DAY}), reverse=True)
    low, high = (date.fromisoformat(str(d)) if d is not None else None for d in (first_day, last_day))
    days = [d for d in days if (low is None or d >= low) and (high is None or d <= high)]
    return days + [None] * (NO_DAY in found and low is None and high is None)


def newest_hits(spark: SparkSession, root: str, query: str = "", size: int = 10, pattern: str = "logs*", message: str = "message",
                newest: tuple[str, ...] = ("@timestamp",), first_day=None, last_day=None,
                index: str | None = None) -> tuple[DataFrame, list[date | None]]:
    """The newest ``size`` matching documents and the days that were opened for them.

    Days are read from the newest back, one, then two, four and so on, until ``size`` hits are
    found: hits of older days cannot come before those of newer ones.  Only hits reach the driver,
    ``size`` at most.  With a token ``index`` of the same documents the days that hold the
    newest hits are counted first, and nothing else is opened.
    """
    logs = read_log_index(spark, root, pattern, first_day, last_day)
    days = days_of(spark, root, pattern, first_day, last_day)
    if index is not None:
        counts = {r["day"]: r["docs"] for r in hits_by_day(spark, index, query).collect()}  # a row for each day
        days = [d for d in days if counts.get(d)]
    found, opened = [], []
    while days and len(found) < size:
        many = _enough(days, counts, size - len(found)) if index is not None else max(1, len(opened))
        now, days = days[:many], days[many:]
        opened += now
        dated = F.col("index_date").isin(*[d for d in now if d is not None])
        chosen = logs.filter(dated | F.col("index_date").isNull() if None in now else dated)
        found += search_logs(chosen, query, size - len(found), message, newest).collect()
    return spark.createDataFrame(found, logs.schema), opened


def _enough(days: list, counts: dict, size: int) -> int:
    """How many of the newest days hold ``size`` hits together."""
    total = 0
    for many, d in enumerate(days, 1):
        total += counts[d]
        if total >= size:
            return many
    return len(days)
