"""From raw submissions to survey rows and to rows per answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.functions.jsontext import any_text, string_only, with_json_object
from canvass.functions.once import compute_once
from canvass.operators.longform import answers_with_question

# Fixed values written into every submission.
SURVEY_ID = "spring_js_survey_v1"
SURVEY_TYPE = "spring_js_hybrid"
SPRING_VERSION = "3.1.0"
ANONYMOUS = "anonymous"

# The answer of a response may be text, a number or a list.
BODY = "userId: variant, responses: array<struct<questionId: string, answer: variant>>"


def answers_from_responses(responses: Column) -> Column:
    """List of (questionId, answer) as a map; of a repeated question the last answer counts.

    A response counts if no later one has its id, so the map is made of distinct keys, the last
    response first, and does not depend on the session's policy for duplicates.  Responses
    without an id are left out.  Ids are compared by a lambda: inside one, ``array_position`` is
    interpreted and ends each search that finds something by an exception.
    """

    def counts(response: Column, position: Column) -> Column:
        later = F.slice(responses, position + 2, F.size(responses))
        return response["questionId"].isNotNull() & ~F.exists(
            later, lambda other: other["questionId"].eqNullSafe(response["questionId"]))

    return F.map_from_entries(F.reverse(F.filter(responses, counts)))


def parse_submissions(raw: DataFrame) -> DataFrame:
    """What request bodies hold, with ``valid``: all that takes time, and nothing that is the same in every row.

    A table to keep where the columns of ``survey_columns`` are wanted several times.
    """
    parsed = with_json_object(raw, "fields", F.col("body"), BODY)
    typed = compute_once(parsed, typed_answers=answers_from_responses(F.col("fields.responses")))
    user = F.when(F.col("fields.userId").isNull(), F.lit(ANONYMOUS)).otherwise(
        string_only(F.col("fields.userId"))
    )
    valid = F.col("fields.responses").isNotNull()
    return typed.withColumns({
        "userId": user,
        "answers": F.transform_values("typed_answers", lambda _, v: any_text(v)),
        "body": F.when(~valid, F.col("body")),
        "valid": valid,
    }).drop("fields")


def survey_columns(parsed: DataFrame, runtime_version: str = "17", survey_id: Column | None = None) -> DataFrame:
    """Survey columns of parsed bodies, the fixed ones included."""
    received = F.col("receivedAt").cast("timestamp")
    return parsed.select(
        (survey_id if survey_id is not None else F.lit(SURVEY_ID)).alias("surveyId"),
        "userId",
        "sessionId",
        "answers",
        received.alias("submittedAt"),
        F.struct(
            F.lit(SURVEY_TYPE).alias("surveyType"),
            F.col("userAgent").alias("browser"),
            "ipAddress",
            "userAgent",
            "referer",
            F.create_map(
                F.lit("javaVersion"), F.lit(runtime_version),
                F.lit("springVersion"), F.lit(SPRING_VERSION),
                F.lit("timestamp"), F.unix_millis(received).cast("string"),
            ).alias("technicalData"),
        ).alias("metadata"),
        "typed_answers",
        "body",
        "valid",
    )


def decode_submissions(raw: DataFrame, runtime_version: str = "17",
                       survey_id: Column | None = None) -> DataFrame:
    """Survey columns out of request bodies, with ``valid``.

    ``raw`` has ``body`` (JSON), ``sessionId``, ``userAgent``, ``referer``, ``ipAddress``
    and ``receivedAt``.  A body without a user is anonymous, while an explicit null stays
    null.  A body that is no object or has no responses is not valid, and only then is its
    text kept.  ``typed_answers`` holds the JSON type of each answer.
    """
    return survey_columns(parse_submissions(raw), runtime_version, survey_id)


def accepted_submissions(decoded: DataFrame) -> DataFrame:
    return decoded.filter("valid").drop("body", "valid")


def refused_submissions(decoded: DataFrame) -> DataFrame:
    return decoded.filter("NOT valid").select("body", "sessionId", "submittedAt")


def normalise_submissions(raw: DataFrame, **options) -> DataFrame:
    """Survey rows of the bodies that are valid; see ``decode_submissions``."""
    return accepted_submissions(decode_submissions(raw, **options))


def answer_rows(surveys: DataFrame, questions: DataFrame, survey_type: str = "java-survey") -> DataFrame:
    """One row per answer with the question's text, ISO time and survey type."""
    utc = F.to_utc_timestamp(F.col("submittedAt").cast("timestamp"), F.current_timezone())
    dated = compute_once(
        surveys, "surveyId", "sessionId", "answers",
        timestamp=F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    )
    rows = dated.select(
        "surveyId", "sessionId", "timestamp", F.explode("answers").alias("questionId", "answer")
    )
    return answers_with_question(rows, questions).select(
        "surveyId", "sessionId", "questionId", "question", "answer", "timestamp",
        F.lit(survey_type).alias("surveyType"),
    )


def intake_problem(messages: DataFrame, texts_only: bool = False) -> DataFrame:
    """Add ``problem``: NULL for a complete message, else what it lacks.

    The relational tables refuse missing fields, and e-mail addresses over 255 characters.
    The worker takes numbers for texts; the intake service, with ``texts_only``, refuses them.
    """
    question, answer, email, message = (
        F.when(F.array_contains("texts", name), F.col(name)) if texts_only else F.col(name)
        for name in ("question", "answer", "email", "message"))
    is_survey = F.col("type") == "survey"
    is_contact = F.col("type") == "contact"
    return messages.withColumn(
        "problem",
        F.when(is_survey & question.isNull(), "question missing")
        .when(is_survey & answer.isNull(), "answer missing")
        .when(is_contact & email.isNull(), "email missing")
        .when(is_contact & message.isNull(), "message missing")
        .when(is_contact & (F.length("email") > 255), "email too long"),
    )
