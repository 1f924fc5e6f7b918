"""Queue messages, one JSON text per row in ``value``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.jsontext import is_json, scalar_text, string_only, with_json_object
from canvass.functions.once import compute_once

FIELDS = ", ".join(f"{name}: variant" for name in (
    "type", "question", "answer", "email", "message", "timestamp"))


TEXTS = ("question", "answer", "email", "message")


def decode_messages(lines: DataFrame) -> DataFrame:
    """Type, fields and forwardable payload of every message.

    Text that is no JSON becomes ``{"raw": text, "type": "unknown"}``.  JSON that is
    not an object cannot be processed: it is kept with ``accepted`` false.  ``texts`` names the
    fields that were given as text, not as numbers.
    """
    value = F.col("value")
    is_object = F.col("item").isNotNull()
    parsed = with_json_object(lines.select("value"), "item", value, FIELDS)
    return (
        compute_once(parsed, broken=~is_object & ~F.coalesce(is_json(value), F.lit(False)))
        .select(
            "value",
            F.when(F.col("broken"), F.lit("unknown"))
            .otherwise(string_only(F.col("item.type"))).alias("type"),
            scalar_text(F.col("item.question")).alias("question"),
            scalar_text(F.col("item.answer")).alias("answer"),
            scalar_text(F.col("item.email")).alias("email"),
            scalar_text(F.col("item.message")).alias("message"),
            F.timestamp_seconds(
                scalar_text(F.col("item.timestamp")).try_cast("double")
            ).alias("queued_at"),
            F.when(
                F.col("broken"),
                F.to_json(F.struct(value.alias("raw"), F.lit("unknown").alias("type"))),
            ).otherwise(value).alias("payload"),
            (is_object | F.col("broken")).alias("accepted"),
            F.array_compact(F.array(*[
                F.when(string_only(F.col(f"item.{name}")).isNotNull(), F.lit(name)) for name in TEXTS
            ])).alias("texts"),
        )
    )
