"""Scores read out of answer texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order in which digits are looked for, and the score of a text
# that holds none of them.
DESCENDING = ("54321", 0)
ASCENDING = ("12345", 0)
TOP_TWO = ("54", 3)

# Answer texts and their score, first match wins.
USEFULNESS = (
    ("Tak, zdecydowanie", 2),
    ("Raczej tak", 1),
    ("Raczej nie", -1),
    ("Nie", -2),
)

# Stems that mark a text as positive or negative.
POSITIVE_STEMS = ("dobr", "super", "świetn")
NEGATIVE_STEMS = ("kieps", "słab", "problem")


def _first_match(cases, otherwise) -> Column:
    """CASE over (condition, value) pairs; a NULL condition does not match."""
    chain = F
    for condition, value in cases:
        chain = chain.when(condition, F.lit(value))
    return chain.otherwise(F.lit(otherwise))


def rating(text: Column, scale: tuple[str, int] = DESCENDING) -> Column:
    """Score of the first digit of the scale that the text contains.

    The three scales differ on texts with several digits and on missing answers:
    '4 lub 5' is 5 descending and 4 ascending; NULL is 0, but 3 with ``TOP_TWO``.
    """
    digits, default = scale
    return _first_match(((text.contains(d), int(d)) for d in digits), default)


def usefulness(text: Column, match: str = "contains") -> Column:
    """Score of a choice answer.

    By containment "Nie wiem" (don't know) scores as "Nie"; ``match="exact"``
    compares whole texts and gives it 0.
    """
    if match == "exact":
        return _first_match(((text == t, v) for t, v in USEFULNESS), 0)
    return _first_match(((text.contains(t), v) for t, v in USEFULNESS), 0)


def _contains_any(text: Column, stems) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(s) for s in stems))


def sentiment(text: Column) -> Column:
    """1.0 with a positive stem, else -1.0 with a negative one, else 0.0; case matters."""
    return _first_match(
        [(_contains_any(text, POSITIVE_STEMS), 1.0), (_contains_any(text, NEGATIVE_STEMS), -1.0)],
        0.0,
    )


def half_up_1(value: Column) -> Column:
    """One decimal, halves rounded towards positive infinity."""
    return F.floor(value * 10 + 0.5) / 10
