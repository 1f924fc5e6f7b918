"""JSON documents with values of mixed type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.once import compute_once

_STRICT = {"allowSingleQuotes": "false"}


def _listed(value: Column) -> Column:
    """The text as the only element of a list, where trailing text is an error."""
    return F.concat(F.lit("["), value, F.lit("]"))


def with_json_object(df: DataFrame, name: str, value: Column, fields: str) -> DataFrame:
    """Add the given fields of a text as a struct, NULL unless it is exactly one JSON object.

    Fields of type variant keep their JSON type: a missing key is NULL, an explicit null
    is a variant.  Of a repeated key the last value counts.
    """
    # a text that opens no object is not parsed: the parser would tell by an exception
    opens = F.ltrim(value, F.lit(" \t\r\n")).startswith("{")
    listed = F.when(opens, F.from_json(_listed(value), f"array<struct<{fields}>>", _STRICT))
    # a list of more than one element was several values
    only = F.transform(F.array(listed), lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0))))
    return compute_once(df, **{name: F.get(only, F.lit(0))})


def is_json(value: Column) -> Column:
    """Whether the text is exactly one JSON value of any kind."""
    parsed = F.try_parse_json(_listed(value))
    one = F.try_variant_get(parsed, "$[0]", "variant").isNotNull()
    more = F.try_variant_get(parsed, "$[1]", "variant").isNotNull()
    return parsed.isNotNull() & one & ~more


def is_list(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def string_only(value: Column) -> Column:
    """Text of a JSON string, NULL for every other kind."""
    return F.when(F.schema_of_variant(value) == "STRING", any_text(value))


def scalar_text(value: Column) -> Column:
    """Text of a string, number or boolean; NULL for lists, objects and null."""
    nested = F.schema_of_variant(value).rlike("^(ARRAY|OBJECT)")
    return F.when(~nested, any_text(value))


def any_text(value: Column) -> Column:
    """Strings as they are, lists and objects as JSON text, null as NULL."""
    return F.try_variant_get(value, "$", "string")
