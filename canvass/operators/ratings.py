"""Rating statistics per tumbling window, and the rating histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.answers import answer
from canvass.functions.scales import ASCENDING, rating
from canvass.schemas import SPRING

# Every value a rating can take.
RATINGS = (0, 1, 2, 3, 4, 5)


def rating_windows(surveys: DataFrame, duration: str = "5 minutes") -> DataFrame:
    """Per window: responses, mean, sample deviation and how often each rating occurs.

    A rating has six possible values, so their counts hold the whole list of ratings in
    six numbers; a window never grows with its responses, in memory or in stream state.
    ``rating_values`` turns the counts back into the list.
    """
    given = surveys.filter(answer(surveys, SPRING).isNotNull()).select(
        "submittedAt", rating(answer(surveys, SPRING), ASCENDING).alias("r")
    )
    counted = given.groupBy(F.window("submittedAt", duration).alias("window")).agg(
        F.count("*").alias("total_responses"),
        F.avg("r").alias("avg_rating"),
        F.stddev("r").alias("rating_stddev"),
        *[F.count_if(F.col("r") == r).alias(f"n{r}") for r in RATINGS],
    )
    counts = F.create_map(*[c for r in RATINGS for c in (F.lit(r), F.col(f"n{r}"))])
    return counted.select(
        "window", "total_responses", "avg_rating", "rating_stddev", counts.alias("rating_counts")
    )


def rating_values(windows: DataFrame, page_size: int = 100_000) -> DataFrame:
    """The list of all ratings of each window, ascending, ``page_size`` of them per row.

    A window with no more responses than that is one row, page 0.
    """
    pages = F.ceil(F.col("total_responses") / page_size).cast("int")
    low = F.col("page").cast("bigint") * page_size
    high = low + page_size
    pieces, start = [], F.lit(0).cast("bigint")
    for r in RATINGS:
        n = F.col("rating_counts")[r]
        inside = F.least(start + n, high) - F.greatest(start, low)
        pieces.append(F.array_repeat(F.lit(r), F.greatest(inside, F.lit(0)).cast("int")))
        start = start + n
    paged = windows.withColumn("page", F.explode(F.sequence(F.lit(0), pages - 1)))
    return paged.withColumn("all_ratings", F.concat(*pieces)).drop("rating_counts")


def rating_distribution(surveys: DataFrame) -> DataFrame:
    """Five rows: the ratings 1 to 5 and how often each was given."""
    text = answer(surveys, SPRING)
    given = surveys.filter(text.isNotNull()).select(rating(text, ASCENDING).alias("r"))
    counts = given.agg(*[F.count_if(F.col("r") == r).alias(f"n{r}") for r in RATINGS[1:]])
    bars = F.array(*[
        F.struct(F.lit(str(r)).alias("label"), F.col(f"n{r}").alias("responses")) for r in RATINGS[1:]
    ])
    return counts.select(F.inline(bars))
