"""Text measures, multi-select splitting and term matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_A_TERM = r"[^\p{L}\p{N}]+"
CONTROL_AND_SPACE = "".join(chr(c) for c in range(0x21))


def word_count(text: Column) -> Column:
    """Number of pieces between single spaces; empty pieces count, '' has one.

    Counting the spaces gives the size of the split without building the pieces.
    """
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def split_options(text: Column) -> Column:
    """Pieces between commas; empty ones are kept, also at the end."""
    return F.split(text, ",")


def split_options_trimmed_tail(text: Column) -> Column:
    """Pieces between commas without the empty ones at the end; '' alone stays one piece."""
    head = F.rtrim(text, F.lit(","))
    return (
        F.when(text == "", F.array(F.lit("")))
        .when(head == "", F.array().cast("array<string>"))
        .otherwise(F.split(head, ","))
    )


def trim_controls(text: Column) -> Column:
    """Trim every character up to the space, not only spaces."""
    return F.btrim(text, F.lit(CONTROL_AND_SPACE))


def terms(query: str) -> list[str]:
    """Lower-case words of a search query."""
    return [t for t in re.split(r"[\W_]+", query.lower()) if t]


def matches_any(text: Column, query: str) -> Column:
    """Whether the text holds at least one of the query's words as a whole word.

    An empty query matches everything; a query without any word matches nothing.
    The plain containment test runs first, so that only texts which may match are
    searched at word borders.
    """
    if not query:
        return F.lit(True)
    words = terms(query)
    if not words:
        return F.lit(False)
    lowered = F.lower(text)
    may_match = F.lit(False)
    for word in words:
        may_match = may_match | lowered.contains(word)
    alternatives = "|".join(words)
    whole_word = lowered.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{alternatives})(?![\p{{L}}\p{{N}}])")
    return F.coalesce(may_match & whole_word, F.lit(False))
