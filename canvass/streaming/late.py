"""Late rows of a stream as a table of their own.

A window query drops rows that come after its watermark.  Here the same bound (the greatest event time of
the batches before, less a delay) parts each batch into rows in time and late rows, and both are
stored.  What the bound was for which batch is written beside the tables, so a restart or a repeated batch
parts its rows as before, and kept and late rows together are always all rows.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canvass.sinks import files
from canvass.sinks.tables import write_batch
from canvass.streaming.intake import _keep, _start


def _times(spark: SparkSession, path: str) -> list[list[int]]:
    """(batch, greatest event time in microseconds up to it) of the last batches."""
    text = files.read_text(spark, path)
    return json.loads(text)["times"] if text else []


def _latest(known: list[list[int]], batch_id: int) -> int | None:
    return max((time for batch, time in known if batch < batch_id), default=None)


def start_keeping_late(stream: DataFrame, out: str, checkpoints: str, name: str, time: str, delay: str,
                       interval: str | None = None) -> StreamingQuery:
    """Store rows in time as ``<out>/<name>`` and those later than ``delay`` as ``<out>/<name>_late``.

    A row is late if its time lies before the greatest time of the batches before, less the delay.
    Rows without a time are in time.
    """
    spark, record = stream.sparkSession, f"{out}/{name}_bounds/times.json"

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = _keep(batch)
        try:
            known = [t for t in _times(spark, record) if t[0] < batch_id]
            before = _latest(known, batch_id)
            at = F.col(time).cast("timestamp")
            bound = F.timestamp_micros(F.lit(before).cast("long")) - F.expr(f"INTERVAL {delay}")
            late = F.coalesce(at < bound, F.lit(False))
            newest = rows.agg(F.max(F.unix_micros(at))).first()[0]
            write_batch(rows.filter(~late), f"{out}/{name}", batch_id)
            write_batch(rows.filter(late), f"{out}/{name}_late", batch_id)
            reached = [t for t in (before, newest) if t is not None]
            if reached:  # a repeated batch needs the one before it
                files.make_folder(spark, record.rsplit("/", 1)[0])
                files.replace_text(spark, record, json.dumps({"times": [*known[-1:], [batch_id, max(reached)]]}))
        finally:
            rows.unpersist()

    return _start(stream, name, write, checkpoints, interval)
