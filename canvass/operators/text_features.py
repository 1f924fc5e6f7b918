"""Length, words and sentiment of free-text answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.answers import answer
from canvass.functions.scales import sentiment
from canvass.functions.text import word_count
from canvass.schemas import SUGGESTIONS


def with_text_features(df: DataFrame, column: str, prefix: str = "suggestion") -> DataFrame:
    text = F.col(column)
    return df.withColumns({
        f"{prefix}_length": F.length(text),
        f"{prefix}_words": word_count(text),
        "sentiment_score": sentiment(text),
    })


def text_analysis(surveys: DataFrame) -> DataFrame:
    """Suggestions that were given, with their features."""
    text = answer(surveys, SUGGESTIONS)
    given = surveys.filter(text.isNotNull()).select(
        "surveyId", "userId", text.alias("suggestion"), "submittedAt"
    )
    return with_text_features(given, "suggestion")
