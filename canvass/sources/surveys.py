"""Survey submissions from tables, document stores and message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass import schemas
from canvass.functions.answers import flatten_answers
from canvass.functions.once import compute_once


def read_surveys(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored submissions with a declared schema, so nothing is inferred.

    Parquet carries its own schema, which also keeps landed answer columns visible.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    return spark.read.schema(schemas.STORED_SURVEY).format(fmt).load(path)


def read_collection(spark: SparkSession, uri: str, database: str, collection: str) -> DataFrame:
    """Document-store collection; needs the store's Spark connector on the class path."""
    return (
        spark.read.schema(schemas.STORED_SURVEY)
        .format("mongodb")
        .option("connection.uri", uri)
        .option("database", database)
        .option("collection", collection)
        .load()
    )


def read_event_topic(spark: SparkSession, servers: str, topic: str = "survey-events",
                     starting: str = "latest", max_offsets: int | None = None) -> DataFrame:
    """Message stream of one topic; needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()


def read_event_files(spark: SparkSession, path: str, fmt: str = "text",
                     schema=None, files_per_trigger: int | None = None) -> DataFrame:
    """The same stream from files: ``text`` gives one message per line in ``value``."""
    reader = spark.readStream.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def decode_events(messages: DataFrame) -> DataFrame:
    """Messages in either layout as survey columns, with ``value`` and ``valid``.

    Native messages carry ``answers`` and ``submittedAt``; messages of the submitting
    service carry ``data`` and epoch milliseconds.  A row is valid when it has both
    answers and a time; the others belong to the dead letters, and only they keep
    their text in ``value``.
    """
    text = F.col("value").cast("string")
    decoded = compute_once(messages, text.alias("value"), e=F.from_json(text, schemas.EVENT))
    return decoded.select(
        "value",
        F.col("e.surveyId").alias("surveyId"),
        F.col("e.userId").alias("userId"),
        F.col("e.sessionId").alias("sessionId"),
        F.coalesce("e.answers", "e.data").alias("answers"),
        F.coalesce("e.submittedAt", F.timestamp_millis("e.timestamp")).alias("submittedAt"),
        F.col("e.metadata").alias("metadata"),
    ).withColumn(
        "valid", F.col("answers").isNotNull() & F.col("submittedAt").isNotNull()
    ).withColumn("value", F.when(~F.col("valid"), F.col("value")))


def valid_events(decoded: DataFrame) -> DataFrame:
    return decoded.filter("valid").drop("value", "valid")


def dead_letters(decoded: DataFrame) -> DataFrame:
    return decoded.filter("NOT valid").select("value")


def landing_frame(surveys: DataFrame, keys=schemas.HOT_ANSWERS) -> DataFrame:
    """Columnar layout for the survey table: hot answers as columns, the day to partition by."""
    flat = flatten_answers(surveys, keys)
    return flat.withColumn("submitted_date", F.to_date("submittedAt"))
