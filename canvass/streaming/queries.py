"""The streaming queries.

Every query keeps a checkpoint of its own.  Output of ``foreachBatch`` goes to a part
per batch, so a batch that is repeated after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from canvass.operators import logs, popularity, ratings, text_features
from canvass.session import STATE
from canvass.sinks.connectors import Writer
from canvass.sinks.files import exists, make_folder
from canvass.sinks.tables import LIST, latest_rows, write_batch, write_snapshot
from canvass.sources.surveys import landing_frame

# Trigger intervals.  Landing feeds the others, so it is as quick as the quickest.
TRIGGERS = {
    "landed_surveys": "10 seconds",
    "text_analysis": "30 seconds",
    "rating_analysis": "1 minute",
    "tech_popularity": "2 minutes",
    "spark_surveys": "10 seconds",
}
RATING_WINDOW = "5 minutes"
WATERMARK = "10 minutes"


def _trigger(interval: str | None) -> dict:
    """``None`` processes what is there and stops."""
    return {"processingTime": interval} if interval else {"availableNow": True}


def _per_batch(df: DataFrame, name: str, mode: str, write: Callable, out: str, checkpoints: str,
               interval: str | None) -> StreamingQuery:
    spark = df.sparkSession
    for key, value in STATE.items():  # also in sessions that others built
        spark.conf.set(key, value)
    return (
        df.writeStream.queryName(name)
        .outputMode(mode)
        .foreachBatch(lambda batch, batch_id: write(batch, f"{out}/{name}", batch_id))
        .option("checkpointLocation", f"{checkpoints}/{name}")
        .trigger(**_trigger(interval))
        .start()
    )


def write_latest(df: DataFrame, path: str, batch_id: int) -> None:
    """Windows that changed; of folded batches each window keeps its newest state."""
    write_batch(df, path, batch_id, fold=partial(latest_rows, keys=["window"]))


def write_partials(df: DataFrame, path: str, batch_id: int) -> None:
    """Partial counts, which folded batches add up."""
    write_batch(popularity.partial_popularity(df), path, batch_id, fold=popularity.merge_partials)


def _own_folder(spark: SparkSession, path: str) -> str:
    """A folder for the file sink, which no table of batches uses."""
    if exists(spark, f"{path}/{LIST}"):
        raise ValueError(f"{path} holds batches; the file sink needs a folder of its own")
    return path


def copying(write: Callable, copy: Writer) -> Callable:
    """Store a batch, then take the stored rows to a further store.

    That store sees a repeated batch again, so it gets the batch's number with the rows.
    """

    def store(batch: DataFrame, path: str, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            write(kept, path, batch_id)
            copy(kept.withColumn("batch_id", F.lit(batch_id)), path.rsplit("/", 1)[-1])
        finally:
            kept.unpersist()

    return store


def start_text(surveys: DataFrame, out: str, checkpoints: str, interval: str | None = None,
               write: Callable = write_batch) -> StreamingQuery:
    """Features of every suggestion, appended."""
    return _per_batch(text_features.text_analysis(surveys), "text_analysis", "append",
                      write, out, checkpoints, interval)


def start_ratings(surveys: DataFrame, out: str, checkpoints: str, interval: str | None = None,
                  duration: str = RATING_WINDOW, watermark: str | None = WATERMARK,
                  write: Callable = write_latest) -> StreamingQuery:
    """Windows that changed; ``latest_per_key`` on the window reads them.

    The watermark bounds the state; later rows are dropped and counted.  Without it the
    state keeps every window for ever.
    """
    if watermark:
        surveys = surveys.withWatermark("submittedAt", watermark)
    return _per_batch(ratings.rating_windows(surveys, duration), "rating_analysis", "update",
                      write, out, checkpoints, interval)


def start_final_ratings(surveys: DataFrame, out: str, checkpoints: str, interval: str | None = None,
                        duration: str = RATING_WINDOW, watermark: str = WATERMARK,
                        write: Callable = write_batch) -> StreamingQuery:
    """Each window once, when no more of its rows are accepted."""
    windows = ratings.rating_windows(surveys.withWatermark("submittedAt", watermark), duration)
    return _per_batch(windows, "rating_final", "append", write, out, checkpoints, interval)


def start_popularity(surveys: DataFrame, out: str, checkpoints: str, interval: str | None = None,
                     write: Callable = write_snapshot) -> StreamingQuery:
    """The whole table at every trigger, with sketched distinct counts."""
    return _per_batch(popularity.tech_popularity(surveys, exact=False), "tech_popularity", "complete",
                      write, out, checkpoints, interval)


def start_popularity_partials(surveys: DataFrame, out: str, checkpoints: str,
                              interval: str | None = None, write: Callable = write_partials) -> StreamingQuery:
    """Exact counts without state: each batch stores its partial counts.

    ``popularity.merge_popularity`` over the stored batches gives the table.
    """
    return _per_batch(surveys, "tech_partials", "append", write, out, checkpoints, interval)


def start_log_counts(events: DataFrame, out: str, checkpoints: str, interval: str | None = None, duration: str = "1 hour",
                     by: tuple[str, ...] = ("level", "role")) -> StreamingQuery:
    """Log events of a union of streams by window of their event time and by labels, each window once it is closed."""
    counted = events.groupBy(F.window("event_time", duration).alias("window"), *by).agg(F.count("*").alias("n"))
    return _per_batch(counted, "log_counts", "append", write_batch, out, checkpoints, interval)


def start_audit(surveys: DataFrame, out: str, checkpoints: str, interval: str | None = None,
                write: Callable | None = None) -> StreamingQuery:
    """Audit documents through the file sink, which itself writes each batch once.

    ``write`` takes them to another store instead, as ``copying`` makes it.
    """
    if write:
        return _per_batch(logs.audit_events(surveys), "spark_surveys", "append", write, out, checkpoints, interval)
    return (
        logs.audit_events(surveys).writeStream.queryName("spark_surveys")
        .outputMode("append").format("parquet")
        .option("path", _own_folder(surveys.sparkSession, f"{out}/spark_surveys"))
        .option("checkpointLocation", f"{checkpoints}/spark_surveys")
        .trigger(**_trigger(interval))
        .start()
    )


def start_landing(surveys: DataFrame, out: str, checkpoints: str, interval: str | None = None) -> StreamingQuery:
    """Submissions in columns, partitioned by day, for reports and for further streams.

    The file sink keeps a log of its files, so a stream that reads the folder sees each row
    once, also after a batch was repeated.
    """
    return (
        landing_frame(surveys).writeStream.queryName("landed_surveys")
        .outputMode("append").format("parquet").partitionBy("submitted_date")
        .option("path", _own_folder(surveys.sparkSession, f"{out}/landed_surveys"))
        .option("checkpointLocation", f"{checkpoints}/landed_surveys")
        .trigger(**_trigger(interval))
        .start()
    )


class LateRows(StreamingQueryListener):
    """Adds up, for each query, the rows that were dropped as too late.

    Register it before the query starts; a query's own progress list forgets old batches.
    """

    def __init__(self) -> None:
        super().__init__()
        self.batches: dict[str, dict[int, int]] = defaultdict(dict)
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        if dropped:  # a repeated batch reports again
            self.batches[str(progress.id)][progress.batchId] = dropped

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.id))

    def count(self, query: StreamingQuery) -> int:
        return sum(self.batches[str(query.id)].values())


def start_all(surveys: DataFrame, out: str, checkpoints: str, once: bool = False) -> list[StreamingQuery]:
    """The analytics queries side by side, after a landing that alone reads and decodes the source.

    They read the few columns they need from the landed files.  With ``once`` the landing runs
    to the end of the data before the others start.
    """
    spark = surveys.sparkSession
    starts = {
        "text_analysis": start_text,
        "rating_analysis": start_ratings,
        "tech_popularity": start_popularity,
        "spark_surveys": start_audit,
    }
    landing = start_landing(surveys, out, checkpoints, None if once else TRIGGERS["landed_surveys"])
    if once:
        landing.awaitTermination()
    make_folder(spark, f"{out}/landed_surveys")
    landed = spark.readStream.schema(landing_frame(surveys).schema).parquet(f"{out}/landed_surveys")
    return [landing, *(
        start(landed, out, checkpoints, None if once else TRIGGERS[name])
        for name, start in starts.items()
    )]


def await_any(spark: SparkSession, queries: list[StreamingQuery]) -> None:
    """Wait until one of the queries ends, then stop the others; its error is raised."""
    try:
        spark.streams.awaitAnyTermination()
    finally:
        for query in queries:
            if query.isActive:
                query.stop()
