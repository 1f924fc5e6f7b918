"""Intake streams: one decoding pass feeds several tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canvass.operators import logs, submissions, text_features
from canvass.operators.submissions import intake_problem
from canvass.operators.token_index import add_to_index
from canvass.session import STATE
from canvass.sinks.messages import Publisher, submission_messages
from canvass.sinks.tables import write_batch
from canvass.sources.queue import decode_messages
from canvass.sources.surveys import dead_letters, decode_events, landing_frame, valid_events
from canvass.streaming.queries import _trigger


def _start(stream: DataFrame, name: str, write, checkpoints: str, interval: str | None) -> StreamingQuery:
    return (
        stream.writeStream.queryName(name).outputMode("append").foreachBatch(write)
        .option("checkpointLocation", f"{checkpoints}/{name}")
        .trigger(**_trigger(interval)).start()
    )


def once_per_delivery(lines: DataFrame, within: str, message: str = "value") -> DataFrame:
    """Lines of a queue without those delivered again within a time after the first.

    The state holds a digest of each message for that time only.  It goes by arrival, so a message that is late
    but new is kept; two messages of equal text, their own time included, are one.
    """
    for key, value in STATE.items():
        lines.sparkSession.conf.set(key, value)
    digest = F.sha2(F.coalesce(F.col(message), F.lit("")).cast("binary"), 256)
    marked = lines.withColumns({"_digest": digest, "_arrived": F.current_timestamp()})
    return marked.withWatermark("_arrived", within).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest", "_arrived")


def _keep(df: DataFrame) -> DataFrame:
    """Keep a batch while it is written several times; a lost block is decoded again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def start_event_intake(messages: DataFrame, out: str, checkpoints: str,
                       interval: str | None = None, write: Callable = write_batch) -> StreamingQuery:
    """Decode a topic once and write all its stateless outputs.

    Landed submissions, text features, audit documents, and the messages that could not
    be read.  For streams to go on from, use ``queries.start_landing``.  ``write`` stores a
    table's batch, as ``queries.copying`` makes it for another store.
    """

    def write_all(batch: DataFrame, batch_id: int) -> None:
        decoded = _keep(decode_events(batch))
        try:
            surveys = valid_events(decoded)
            write_batch(landing_frame(surveys), f"{out}/survey_responses", batch_id, ["submitted_date"])
            write(text_features.text_analysis(surveys), f"{out}/text_analysis", batch_id)
            write(logs.audit_events(surveys), f"{out}/spark_surveys", batch_id)
            write(dead_letters(decoded), f"{out}/dead_letters", batch_id)
        finally:
            decoded.unpersist()

    return _start(messages, "event_intake", write_all, checkpoints, interval)


def start_submissions(bodies: DataFrame, out: str, checkpoints: str, interval: str | None = None,
                      publish: Publisher | None = None, write: Callable = write_batch) -> StreamingQuery:
    """Each submission to the store, to the topic and to the log.

    ``publish`` sends messages on; by default they are stored as a table.  The store keeps the
    JSON type of each answer.  ``write`` stores a table's batch, as ``queries.copying`` makes
    it for another store.
    """

    def write_all(batch: DataFrame, batch_id: int) -> None:
        parsed = _keep(submissions.parse_submissions(batch))
        try:
            decoded = submissions.survey_columns(parsed)
            surveys = submissions.accepted_submissions(decoded)
            write(surveys, f"{out}/survey_responses", batch_id)
            messages = submission_messages(surveys)
            if publish:
                publish(messages, batch_id)
            else:
                write(messages, f"{out}/survey_events", batch_id)
            write(logs.submission_log(surveys), f"{out}/logs", batch_id)
            write(submissions.refused_submissions(decoded), f"{out}/refused", batch_id)
        finally:
            parsed.unpersist()

    return _start(bodies, "submissions", write_all, checkpoints, interval)


def route(decoded: DataFrame) -> dict[str, DataFrame]:
    """Where queue messages go.

    Surveys and contacts are stored with the time of storing, unless they are incomplete;
    every message that is an object, or no JSON at all, is forwarded, stored or not.
    """
    checked = intake_problem(decoded.filter("accepted"))
    stored = checked.filter("problem IS NULL")
    return {
        "survey_responses": stored.filter("type = 'survey'").select(
            "question", "answer", F.current_timestamp().alias("created_at")),
        "contact_messages": stored.filter("type = 'contact'").select(
            "email", "message", F.current_timestamp().alias("created_at")),
        "forwarded": checked.select(F.col("payload").alias("value")),
        "dead_letters": checked.filter("problem IS NOT NULL").select("value", "problem").unionAll(
            decoded.filter("NOT accepted").select("value", F.lit("not an object"))),
    }


def start_router(lines: DataFrame, out: str, checkpoints: str, interval: str | None = None,
                 publish: Publisher | None = None, write: Callable = write_batch,
                 redelivery: str | None = None) -> StreamingQuery:
    """Queue worker: store by type and forward.

    ``redelivery`` is the time in which a queue may deliver a message again; such copies are dropped.
    ``write`` stores a table's batch, as ``queries.copying(write_batch, to_tables(...))`` makes
    it for a relational store.
    """

    def write_all(batch: DataFrame, batch_id: int) -> None:
        decoded = _keep(decode_messages(batch))
        try:
            for name, rows in route(decoded).items():
                if name == "forwarded" and publish:
                    publish(rows, batch_id)
                else:
                    write(rows, f"{out}/{name}", batch_id)
        finally:
            decoded.unpersist()

    if redelivery:
        lines = once_per_delivery(lines, redelivery)
    return _start(lines, "queue_router", write_all, checkpoints, interval)


def start_visits(hits: DataFrame, out: str, checkpoints: str, interval: str | None = None,
                 page: str = "home") -> StreamingQuery:
    """One visit row per hit, with the time of storing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        visits = batch.select(F.lit(page).alias("page"), F.current_timestamp().alias("visited_at"))
        write_batch(visits, f"{out}/page_visits", batch_id)

    return _start(hits, "page_visits", write, checkpoints, interval)


def start_log_routing(events: DataFrame, out: str, checkpoints: str,
                      interval: str | None = None) -> StreamingQuery:
    """Log documents into index folders by type and day.

    The day is that of the document, or of its arrival where it has no readable time.
    """
    arrived = events.withColumn("ingested_at", F.current_timestamp())
    routed = logs.route_index(logs.normalise_time(arrived)).drop("ingested_at")
    return (
        routed.writeStream.queryName("log_routing").outputMode("append").format("parquet")
        .partitionBy("index_name", "index_date")
        .option("path", f"{out}/log_index")
        .option("checkpointLocation", f"{checkpoints}/log_routing")
        .trigger(**_trigger(interval)).start()
    )


def start_token_index(docs: DataFrame, out: str, checkpoints: str, interval: str | None = None, **columns) -> StreamingQuery:
    """Extend the word index of a stream of documents by each micro-batch; ``columns`` as of ``add_to_index``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        add_to_index(batch, f"{out}/token_index", batch_id, **columns)

    return _start(docs, "token_index", write, checkpoints, interval)
