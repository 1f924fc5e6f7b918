"""Landed submissions whose answer columns grow with the answers that come.

The answers of a document are a map; keys that many submissions hold are worth a column of their own.
Which keys have columns is a version, recorded beside the landed files with the kinds of their values.  A
landing looks at the answers it brings, and where new keys have become frequent it records a further version.
Files of all versions are read as one: what a file has no column for comes from its map.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from canvass import schemas
from canvass.sinks import files
from canvass.sinks.tables import write_partitioned
from canvass.sources.surveys import landing_frame

VERSIONS = "_answers.json"
#: Share of the submissions of a landing that must hold a key before it gets a column, and new columns of one landing.
SHARE, MOST = 0.01, 64


def answer_kinds(surveys: DataFrame) -> DataFrame:
    """(key, n, kind): how many submissions hold each answer, and the one type that fits all its values.

    Values that are JSON count by their JSON type, others as texts.
    """
    values = surveys.select(F.explode("answers").alias("key", "value")).filter("value IS NOT NULL")
    parsed = F.coalesce(F.try_parse_json("value"), F.parse_json(F.to_json(F.array("value"))))
    return values.groupBy("key").agg(F.count("*").alias("n"), F.schema_of_variant_agg(parsed).alias("kind"))


def versions(spark: SparkSession, path: str) -> list[dict]:
    """The recorded versions, oldest first; each has its number, its keys and the kinds of their values."""
    text = files.read_text(spark, f"{path}/{VERSIONS}")
    first = {"version": 1, "keys": list(schemas.HOT_ANSWERS), "kinds": {}}
    return json.loads(text) if text else [first]


def evolve(surveys: DataFrame, path: str, share: float = SHARE) -> dict:
    """The version to land these submissions with; a new one is recorded if keys have become frequent."""
    spark = surveys.sparkSession
    known = versions(spark, path)
    now = known[-1]
    taken = {c.lower() for c in [*now["keys"], *(f.name for f in schemas.STORED_SURVEY), "submitted_date"]}
    total = surveys.count()
    frequent = answer_kinds(surveys).filter((F.col("n") >= share * total) & ~F.lower("key").isin(*taken))
    rows = frequent.orderBy(F.desc("n"), "key").limit(MOST).collect()
    new = list({r["key"].lower(): r for r in reversed(rows)}.values())[::-1]  # names of columns differ by more than case
    if new:
        now = {"version": now["version"] + 1, "keys": [*now["keys"], *(r["key"] for r in new)], "kinds": now["kinds"] | {r["key"]: r["kind"] for r in new}}
        files.make_folder(spark, path)
        files.replace_text(spark, f"{path}/{VERSIONS}", json.dumps([*known, now]))
    return now


def land_evolving(surveys: DataFrame, path: str, share: float = SHARE) -> DataFrame:
    """Store submissions by day as ``land_surveys`` does, with a column for each answer of the newest version."""
    now = evolve(surveys, path, share)
    landed = landing_frame(surveys, now["keys"]).withColumn("answers_version", F.lit(now["version"]))
    write_partitioned(landed, path, ["submitted_date"], "replace")
    return read_evolving(surveys.sparkSession, path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """All landed submissions with the answer columns of the newest version, whatever version their file is of.

    The schema is that of one file of the newest layout and the recorded keys, so no footers are merged.
    A column that is asked for is read; the map only where a file is of an older version.
    """
    known = versions(spark, path)
    keys = known[-1]["keys"]
    stored = spark.read.parquet(path).schema
    names = {f.name for f in stored}
    schema = StructType([*stored.fields, *(StructField(k, StringType()) for k in keys if k not in names)])
    if "answers_version" not in names:
        schema = schema.add("answers_version", "int")
    rows = spark.read.schema(schema).parquet(path)
    since = {k: v["version"] for v in reversed(known) for k in v["keys"]}
    filled = {k: F.when(F.coalesce("answers_version", F.lit(1)) >= n, F.col(f"`{k}`")).otherwise(F.col("answers")[k])
              for k, n in since.items() if n > 1}
    return rows.withColumns(filled) if filled else rows
