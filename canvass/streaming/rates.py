"""Counter rates of a stream of samples, equal to those of the whole table.

The rate of a sample needs the samples of its series in the range before it.  Between micro-batches
a small table carries them over: of each series the samples of the last range and of the allowed
lateness.  A batch rates its samples together with the carried ones; a late sample changes the
rates behind it, so these are given again, and the newest rate of a sample counts.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canvass.operators.samples import MICROS, _series_key, counter_rate
from canvass.sinks.tables import latest_per_key, latest_rows, read_batches, read_snapshot_before, write_batch, write_snapshot
from canvass.streaming.intake import _keep, _start

SAMPLE = "metric string, labels map<string,string>, ts timestamp, value double"
KEYS = ["metric", "series", "ts", "value"]
SERIES = ["metric", "labels", "series", "ts", "value"]


def _by_series(rows: DataFrame, found: Column) -> DataFrame:
    """(m, s, found) for each series, to be joined by ``_same``."""
    return rows.groupBy(F.col("metric").alias("m"), F.col("series").alias("s")).agg(found.alias("found"))


def _same() -> Column:
    return F.col("metric").eqNullSafe(F.col("m")) & F.col("series").eqNullSafe(F.col("s"))


def _before(ts: str | Column, seconds: int) -> Column:
    return F.unix_micros(ts) - seconds * MICROS


def start_rates(samples: DataFrame, out: str, checkpoints: str, range_seconds: int = 300, lateness_seconds: int = 600,
                interval: str | None = None) -> StreamingQuery:
    """Store the rates of a stream of samples as ``<out>/rates``; ``read_rates`` reads them.

    A sample may come up to ``lateness_seconds`` after a newer one of its series; those that are later are
    stored, unrated, as ``<out>/late_samples``.  Samples equal in series, time and value count once.
    """
    spark = samples.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.select("metric", "labels", _series_key().alias("series"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
        carried = read_snapshot_before(spark, f"{out}/carried", batch_id)
        carried = (spark.createDataFrame([], SAMPLE) if carried is None else carried).withColumn("series", _series_key())
        newest = _by_series(carried, F.max("ts"))
        late = F.coalesce(F.unix_micros("ts") < _before("found", lateness_seconds), F.lit(False))
        dated = _keep(fresh.join(newest, _same(), "left").select(*SERIES, late.alias("late")))
        # the rows of a batch are grouped once; all that follows reads the different samples
        new = dated.filter("NOT late").select(*SERIES, F.lit(True).alias("new"))
        known = carried.select(*SERIES, F.lit(False).alias("new")).unionByName(new)
        known = _keep(known.groupBy(*KEYS).agg(F.max("new").alias("new")).withColumn("labels", F.map_from_entries("series")))
        try:
            # what a batch changes: the rates of each series from its oldest new sample on
            oldest = _by_series(known.filter("new"), F.min("ts"))
            rated = counter_rate(known.select("metric", "labels", "ts", "value"), range_seconds).withColumn("series", _series_key())
            rated = rated.join(oldest, _same()).filter("ts >= found").select("metric", "labels", "series", "ts", "value", "rate")
            write_batch(rated, f"{out}/rates", batch_id, fold=partial(latest_rows, keys=KEYS))
            write_batch(dated.filter("late").drop("late", "series"), f"{out}/late_samples", batch_id)
            last = _by_series(known, F.max("ts"))
            kept = known.join(last, _same()).filter(F.unix_micros("ts") > _before("found", range_seconds + lateness_seconds))
            write_snapshot(kept.select("metric", "labels", "ts", "value"), f"{out}/carried", batch_id)
        finally:
            known.unpersist()
            dated.unpersist()

    return _start(samples, "rates", write, checkpoints, interval)


def read_rates(spark: SparkSession, out: str) -> DataFrame:
    """metric, labels, ts, value and the newest rate of each sample."""
    return latest_per_key(read_batches(spark, f"{out}/rates"), KEYS).drop("series")
