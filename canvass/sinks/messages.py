"""Rows as messages of a topic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def submission_messages(surveys: DataFrame) -> DataFrame:
    """Message of the submitting service, keyed by session.

    The survey id is the same in almost every message, so as a key it would send them all
    to one partition.
    """
    body = F.struct(
        F.lit("SURVEY_SUBMITTED").alias("type"),
        "surveyId", "userId",
        F.unix_millis(F.col("submittedAt").cast("timestamp")).alias("timestamp"),
        F.col("answers").alias("data"),
    )
    return surveys.select(F.col("sessionId").alias("key"), F.to_json(body).alias("value"))


Publisher = Callable[[DataFrame, int], None]


def to_topic(servers: str, topic: str) -> Publisher:
    """Writer of a batch's ``key`` and ``value`` to a topic; needs the Kafka connector.

    A repeated batch sends its messages again, so each carries the batch's number as a header.
    """

    def publish(messages: DataFrame, batch_id: int) -> None:
        header = F.array(F.struct(F.lit("batch_id").alias("key"), F.lit(str(batch_id)).cast("binary").alias("value")))
        (
            messages.withColumn("headers", header).write.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic).option("includeHeaders", "true")
            .save()
        )

    return publish
