"""Statistics over one row per answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators.paging import PAGE_SIZE, nest_pages


# What a browser trims, the blanks of Unicode, line ends and the byte order mark.
BLANKS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def clean_answers(answers: DataFrame) -> DataFrame:
    """Trim answers and leave out the blank and missing ones."""
    trimmed = F.regexp_replace("answer", rf"^{BLANKS}+|{BLANKS}+$", "")
    return answers.withColumn("answer", trimmed).filter(F.col("answer") != "")


def answer_counts(answers: DataFrame) -> DataFrame:
    return answers.groupBy("question", "answer").agg(F.count("*").alias("count"))


def counts_in_order(counts: DataFrame) -> DataFrame:
    """Questions ascending, frequent answers first, ties by answer."""
    return counts.orderBy("question", F.desc("count"), "answer")


def answers_nested(counts: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Per question the list of its answers with their counts, frequent ones first."""
    return nest_pages(
        counts, by=["question"], key="answer", count="count",
        sort=[F.desc("count"), F.col("answer")],
        name="answers", page_size=page_size,
    )


def visit_total(visits: DataFrame) -> DataFrame:
    return visits.agg(F.count("*").alias("total_visits"))


def distinct_answer_pairs(counts: DataFrame) -> DataFrame:
    """Number of (question, answer) pairs, reported as the total of responses."""
    return counts.agg(F.count("*").alias("total_responses"))


def survey_totals(counts: DataFrame, visits: DataFrame) -> DataFrame:
    """Both totals of the statistics page in one row."""
    parts = visit_total(visits).select("total_visits", F.lit(0).cast("bigint").alias("total_responses"))
    parts = parts.unionAll(
        distinct_answer_pairs(counts).select(F.lit(0).cast("bigint"), "total_responses")
    )
    return parts.agg(
        F.sum("total_visits").alias("total_visits"), F.sum("total_responses").alias("total_responses")
    )


def chart_labels(counts: DataFrame) -> DataFrame:
    """One chart segment per pair, labelled "question: answer"."""
    return counts.select(
        F.concat(F.col("question"), F.lit(": "), F.col("answer")).alias("label"),
        F.col("count").alias("data"),
    )


def answers_with_question(answers: DataFrame, questions: DataFrame, key: str = "questionId") -> DataFrame:
    """Add the question's text, '' where the catalogue has none.

    Ids are compared as text.  Of several questions with one id the first counts.
    """
    texts = questions.groupBy(F.col("id").cast("string").alias("catalogue_id")).agg(
        F.min_by("text", "position").alias("text")
    )
    return (
        answers.join(texts, F.col(key).cast("string") == F.col("catalogue_id"), "left")
        .withColumn("question", F.coalesce("text", F.lit("")))
        .drop("catalogue_id", "text")
    )
