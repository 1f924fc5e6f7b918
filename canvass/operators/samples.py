"""Metric samples: selection, counter rates, averages by label.

Samples have ``metric``, ``labels``, ``ts`` and ``value``.  A series is one metric with
one set of labels.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MICROS = 1_000_000


def select_metric(samples: DataFrame, metric: str, **labels: str) -> DataFrame:
    hits = samples.filter(F.col("metric") == metric)
    for name, value in labels.items():
        hits = hits.filter(F.col("labels")[name] == value)
    return hits


def _series_key() -> Column:
    """Labels in a form that can be grouped by, independent of their order."""
    return F.array_sort(F.map_entries("labels"))


def latest_samples(samples: DataFrame, at=None, lookback_seconds: int | None = None) -> DataFrame:
    """The newest value of each series, optionally as of a time and not older than a span."""
    if at is not None:
        at = F.lit(at).cast("timestamp")
        samples = samples.filter(F.col("ts") <= at)
        if lookback_seconds is not None:
            samples = samples.filter(F.col("ts") > at - F.make_dt_interval(secs=F.lit(lookback_seconds)))
    newest = samples.groupBy("metric", _series_key().alias("series")).agg(
        F.max("ts").alias("ts"), F.max_by("value", "ts").alias("value")
    )
    return newest.select("metric", F.map_from_entries("series").alias("labels"), "ts", "value")


def _steps(samples: DataFrame, range_seconds: int, bucket_seconds: int) -> tuple[DataFrame, W]:
    """Samples with the increase since their predecessor, per series and time bucket.

    A window over a whole series would put a busy series into one task.  A rate looks back
    only ``range_seconds``, so the series are cut into time buckets, and the samples at the
    end of a bucket are repeated at the start of the next one (``own`` is false there).
    """
    if bucket_seconds < range_seconds:
        raise ValueError("a bucket must be at least as long as the range")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    bucket = bucket_seconds * MICROS
    first = F.expr(f"us div {bucket}")
    last = F.expr(f"(us + {range_seconds * MICROS - 1}) div {bucket}")
    spread = (
        samples.select("metric", "labels", _series_key().alias("series"), "ts", "value",
                       micros.alias("us"))
        .withColumn("bucket", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))
        .withColumn("own", F.col("bucket") == first)
    )
    part = W.partitionBy("metric", "series", "bucket")
    ordered = part.orderBy("us", "value")
    previous = F.lag("value").over(ordered)
    # after a reset the counter starts from zero
    step = F.when(F.col("value") < previous, F.col("value")).otherwise(F.col("value") - previous)
    return spread.withColumns({
        "previous_us": F.lag("us").over(ordered),
        "step": F.coalesce(step, F.lit(0.0)),
    }), part


def counter_rate(samples: DataFrame, range_seconds: int = 300, bucket_seconds: int | None = None) -> DataFrame:
    """Rate per second at the time ``t`` of every sample over the samples in ``(t - range, t]``.

    The increase from the first to the last sample there, corrected for resets, divided by
    the time between them; NULL with fewer than two.

    A sliding frame would go over all its samples again for each of them, which a dense series
    does not allow.  Instead every sample also asks, at the start of its range, for the first
    sample after that; going back in time, it is the last one passed.
    """
    steps, part = _steps(samples, range_seconds, bucket_seconds or 12 * range_seconds)
    running = part.orderBy("us", "value").rowsBetween(W.unboundedPreceding, 0)
    totals = steps.withColumn("total", F.sum("step").over(running))
    asks, is_sample = F.lit(False), F.col("is_sample")
    marks = totals.withColumn(
        "is_sample", F.explode(F.when(F.col("own"), F.array(asks, F.lit(True))).otherwise(F.array(F.lit(True))))
    ).withColumn("at", F.when(is_sample, F.col("us")).otherwise(F.col("us") - range_seconds * MICROS))
    # a sample exactly at the start is outside, so the question comes before it
    back = part.orderBy(F.desc("at"), "is_sample", F.desc("us"), F.desc("value")).rowsBetween(W.unboundedPreceding, 0)
    rated = marks.withColumns({
        "low": F.last(F.when(is_sample, F.col("total")), ignorenulls=True).over(back),
        "since": F.last(F.when(is_sample, F.col("us")), ignorenulls=True).over(back),
    })
    return rated.filter(~is_sample).select(
        "metric", "labels", "ts", "value",
        F.try_divide(F.col("total") - F.col("low"), (F.col("us") - F.col("since")) / MICROS).alias("rate"),
    )


def rate_on_grid(samples: DataFrame, range_seconds: int = 300, step_seconds: int = 60,
                 bucket_seconds: int | None = None) -> DataFrame:
    """The same rate at common times, all multiples of ``step_seconds``.

    The samples are first added up to slots that divide both the step and the range, so only one row
    per series and slot is repeated for the grid times whose range holds it.  The step into a
    slot counts only where the sample before it is in the range as well.
    """
    steps, _ = _steps(samples, range_seconds, bucket_seconds or 12 * range_seconds)
    slot = gcd(range_seconds, step_seconds) * MICROS
    step, span = step_seconds * MICROS, range_seconds * MICROS
    # times after 1970 are positive, for which div rounds down; a slot ends at its number
    number = F.expr(f"(us + {slot - 1}) div {slot}")
    placed = steps.filter("own").withColumn("slot", number)
    within = F.col("previous_us") > (F.col("slot") - 1) * slot
    slots = placed.groupBy("metric", "series", "slot").agg(
        F.sum(F.when(within, F.col("step")).otherwise(0.0)).alias("inner"),
        F.sum(F.when(within, 0.0).otherwise(F.col("step"))).alias("entry"),
        F.min("previous_us").alias("before"),
        F.min("us").alias("first"), F.max("us").alias("last"),
    )
    first = F.expr(f"(slot * {slot} + {step - 1}) div {step}")
    last = F.expr(f"((slot - 1) * {slot} + {span}) div {step}")
    on_grid = (
        slots.filter(first <= last)
        .withColumn("k", F.explode(F.sequence(first, last)))
        .withColumn("eval_us", F.col("k") * step)
    )
    inside = F.col("before") > F.col("eval_us") - span
    total = F.sum(F.col("inner") + F.when(inside, F.col("entry")).otherwise(0.0))
    seconds = (F.max("last") - F.min("first")) / MICROS
    return (
        on_grid.groupBy("metric", "series", "eval_us")
        .agg(F.try_divide(total, seconds).alias("rate"))
        .select(
            "metric", F.map_from_entries("series").alias("labels"),
            F.timestamp_micros("eval_us").alias("eval_ts"), "rate",
        )
    )


# The counter of processor seconds and its idle mode.
CPU_SECONDS, IDLE = "node_cpu_seconds_total", "idle"


def busy_percent(samples: DataFrame, by: str = "instance", range_seconds: int = 300,
                 step_seconds: int = 60, metric: str = CPU_SECONDS, mode: str = IDLE) -> DataFrame:
    """100 minus the mean idle rate in percent, per label value and grid time."""
    idle = select_metric(samples, metric, mode=mode)
    rates = rate_on_grid(idle, range_seconds, step_seconds).filter(F.col("rate").isNotNull())
    return rates.groupBy(F.col("labels")[by].alias(by), "eval_ts").agg(
        (100 - F.avg("rate") * 100).alias("busy_pct")
    )
