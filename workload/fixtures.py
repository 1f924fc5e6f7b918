"""Survey data derived from the given tables.

The expressions are portable, so Spark and the SQL check read the same rows: one
submission per event, one long-form answer per event, queue lines, log entries and
metric samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.operators import relabel as r
from canvass.functions.once import compute_once
from canvass.operators.samples import CPU_SECONDS
from canvass.schemas import HOT_ANSWERS
from canvass.session import work_dir


def _rating(number: str, low: str, high: str, two: str) -> str:
    return (
        f"CASE {number} WHEN 0 THEN NULL WHEN 1 THEN '1 - {low}' WHEN 2 THEN '2' WHEN 3 THEN '3' "
        f"WHEN 4 THEN '4' WHEN 5 THEN '5 - {high}' WHEN 6 THEN 'brak' ELSE '{two}' END"
    )


SURVEY_COLUMNS = {
    "event_id": "event_id",
    "surveyId": "'survey_v' || CAST(event_id % 3 AS VARCHAR(9))",
    "userId": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'u' || CAST(user_id AS VARCHAR(9)) END",
    "sessionId": "'s' || CAST(user_id AS VARCHAR(9)) || '_' || CAST(CAST(ts AS DATE) AS VARCHAR(10))",
    "submittedAt": "ts",
    "spring_performance": _rating("(event_id * 5 + user_id) % 8", "Słabo", "Doskonale", "4 lub 5"),
    "java_tech_interest": (
        "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'Spring Boot' "
        "WHEN 2 THEN 'Spring Boot, Apache Spark' WHEN 3 THEN 'Apache Spark,MongoDB ' "
        "WHEN 4 THEN 'Hibernate,,Quarkus' WHEN 5 THEN 'Kafka Streams,' WHEN 6 THEN '' "
        "WHEN 7 THEN 'Micronaut, MongoDB, Apache Spark' ELSE ' Quarkus' END"
    ),
    "integration_quality": _rating("(event_id * 3 + user_id) % 8", "Słaba", "Doskonała", "1 lub 5"),
    "elk_usefulness": (
        "CASE (event_id + user_id * 3) % 6 WHEN 0 THEN 'Tak, zdecydowanie' WHEN 1 THEN 'Raczej tak' "
        "WHEN 2 THEN 'Nie wiem' WHEN 3 THEN 'Raczej nie' WHEN 4 THEN 'Nie' ELSE NULL END"
    ),
    "architecture_suggestions": (
        "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'super architektura' "
        "WHEN 2 THEN 'to jest  dobre' WHEN 3 THEN 'świetny pomysł' WHEN 4 THEN 'słaba wydajność' "
        "WHEN 5 THEN 'problem z kolejką' WHEN 6 THEN 'super, ale problem' ELSE 'Super' END"
    ),
}

LONG_COLUMNS = {
    "event_id": "event_id",
    "question": "'Pytanie ' || CAST(event_id % 5 + 1 AS VARCHAR(9))",
    "answer": (
        "CASE event_id % 5 WHEN 0 THEN CAST((event_id + user_id) % 5 + 1 AS VARCHAR(9)) "
        "WHEN 4 THEN '  ' || event_type || ' ' ELSE event_type END"
    ),
    "created_at": "ts",
}

# Kind of JSON the technology answer takes in a request body: text, list, number, none.
BODY_KIND = "event_id % 4"

# Event ids grow with time, so their remainder is a counter that starts over now and then.
SAMPLE_COLUMNS = {
    "event_id": "event_id",
    "metric": "event_type",
    "instance": "'u' || CAST(user_id % 2 AS VARCHAR(9))",
    "ts": "ts",
    "value": "CAST(event_id % 1000 AS DOUBLE)",
}

LOG_COLUMNS = {
    "event_id": "event_id",
    "level": "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END",
    "message": "'Survey submitted: survey_v' || CAST(event_id % 3 AS VARCHAR(9))",
    "type": "CASE event_id % 3 WHEN 0 THEN 'survey' WHEN 1 THEN 'spark' ELSE event_type END",
    "ts": "ts",
}

POD_COLUMNS = {
    "event_id": "event_id",
    "mirror": "CASE WHEN event_type = 'error' THEN 'mirror' WHEN event_type = 'click' THEN 'mirrored' ELSE '' END",
    "scrape": "CASE WHEN user_id % 3 = 0 THEN 'false' ELSE 'true' END",
    "container": "event_type",
    "pod": "'pod-' || CAST(user_id AS VARCHAR(9))",
    "namespace": "CASE WHEN user_id % 5 = 0 THEN '' ELSE 'ns' || CAST(user_id % 5 AS VARCHAR(9)) END",
    "uid": "'uid-' || CAST(event_id AS VARCHAR(12))",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events dealt over as many tasks as their rows ask for.

    A file of few row groups, however many rows it has, would otherwise be decoded by few tasks.
    """
    events = table(spark, sf_dir, "events")
    return events.repartition(max(1, -(-events.count() // FILE_ROWS)), "event_id")


#: Micro-batches that a stream of events comes in, the least files of each, and how late the late rows are.
FILES, PARTS, LATE = 4, 2, "5 minutes"
#: Rows beyond which a micro-batch gets more files, and a table more tasks.
FILE_ROWS = 50_000


def event_table_stream(spark: SparkSession, sf_dir: str, again: int | None = None, closing: bool = False) -> DataFrame:
    """The events as a stream of several files in the order of time, ``PARTS`` or more for each micro-batch.

    The files of a batch grow in number, not in size, so larger tables are spread over more tasks.
    Each seventh event of the last minutes of a batch comes late, in the next one.  With ``again``
    the events whose id it divides come a second time in the next batch.  With ``closing`` a last
    batch holds one event two days later, so that all windows close before the stream ends.
    """
    events = table(spark, sf_dir, "events")
    folder = work_dir(spark, "event_files")
    low, high, rows = events.agg(F.unix_micros(F.min(F.col("ts").cast("timestamp"))), F.unix_micros(F.max(F.col("ts").cast("timestamp"))), F.count("*")).first()
    parts = max(PARTS, -(-rows // (FILES * FILE_ROWS)))
    delay = F.when(F.col("event_id") % 7 == 0, F.expr(f"INTERVAL {LATE}")).otherwise(F.expr("INTERVAL 0 minutes"))
    arrival = F.unix_micros((F.col("ts") + delay).cast("timestamp")) - low
    number = F.least(F.floor(arrival * FILES / (high - low + 1)), F.lit(FILES - 1))
    twice = (F.col("event_id") % again == 0) if again else F.lit(False)
    for k in range(FILES):
        events.filter((number == k) | (twice & (number == k - 1))).repartition(parts).write.mode("append").parquet(folder)
    if closing:
        last = events.orderBy(F.desc("ts"), "event_id").limit(1).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 2 days"), "event_type": F.lit("closing")})
        last.write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", parts).parquet(folder)


def project(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def sql(columns: dict[str, str], source: str = "events") -> str:
    """The same projection as text of a SELECT."""
    listed = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return f"SELECT {listed} FROM {source}"


def surveys(events: DataFrame) -> DataFrame:
    """Submissions in the landed layout, one column per answer."""
    return project(events, SURVEY_COLUMNS)


def answer_map():
    pairs = [c for key in HOT_ANSWERS for c in (F.lit(key), F.col(key))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def with_answer_map(flat: DataFrame) -> DataFrame:
    """Submissions in the document layout, answers in a map without the missing ones."""
    others = [c for c in flat.columns if c not in HOT_ANSWERS]
    return compute_once(flat, *others, answers=answer_map())


def event_messages(events: DataFrame, planted: bool = False) -> DataFrame:
    """Submissions as JSON messages, those of clicks in the layout of the submitting service.

    With ``planted`` the messages of signups are cut off.
    """
    flat = project(events, {**SURVEY_COLUMNS, "event_type": "event_type"})
    # JSON leaves out fields without a value, so a struct gives the text of a map of the answers
    flat = compute_once(flat, *[c for c in flat.columns if c not in HOT_ANSWERS], answers=F.struct(*HOT_ANSWERS))
    ts = F.col("submittedAt").cast("timestamp")
    native = F.to_json(F.struct(
        "surveyId", "userId", "sessionId", "answers", ts.alias("submittedAt"),
        F.struct(F.lit("web").alias("surveyType")).alias("metadata"),
    ))
    service = F.to_json(F.struct(
        F.lit("SURVEY_SUBMITTED").alias("type"), "surveyId", "userId",
        F.unix_millis(ts).alias("timestamp"), F.col("answers").alias("data"),
    ))
    value = F.when(F.col("event_type") == "click", service).otherwise(native)
    if planted:
        cut = F.concat(F.lit('{"surveyId": '), F.col("event_id").cast("string"))
        value = F.when(F.col("event_type") == "signup", cut).otherwise(value)
    return compute_once(flat, value=value).select("value")


def request_bodies(events: DataFrame) -> DataFrame:
    """Request bodies with a repeated question, and technologies as text, list or number.

    Some bodies have no responses, others are no object.
    """
    flat = surveys(events).withColumn("kind", F.expr(BODY_KIND))

    def entry(key, json):
        return F.concat(F.lit(f'{{"questionId":"{key}","answer":'), json, F.lit("}"))

    def text(column):
        return F.concat(F.lit('"'), F.col(column), F.lit('"'))

    technologies = (
        F.when(F.col("kind") == 1, F.to_json(F.split("java_tech_interest", ",")))
        .when(F.col("kind") == 2, F.lit("7"))
        .otherwise(text("java_tech_interest"))
    )
    listed = F.concat_ws(
        ",",
        entry("spring_performance", F.lit('"3"')),
        entry("java_tech_interest", technologies),
        entry("spring_performance", text("spring_performance")),
    )
    user = F.when(F.col("userId").isNull(), F.lit("")).when(
        F.col("elk_usefulness").isNull(), F.lit('"userId":null,')
    ).otherwise(F.concat(F.lit('"userId":"'), "userId", F.lit('",')))
    body = F.concat(F.lit("{"), user, F.lit('"responses":['), listed, F.lit("]}"))
    body = (
        F.when(F.col("architecture_suggestions") == "Super", F.lit('{"responses":null}'))
        .when(F.col("architecture_suggestions") == "problem z kolejką", F.lit("[]"))
        .otherwise(body)
    )
    return compute_once(flat, "sessionId", "submittedAt", body=body).select(
        "body", "sessionId",
        F.lit("agent").alias("userAgent"), F.lit("/new-survey").alias("referer"),
        F.lit("10.0.0.1").alias("ipAddress"),
        F.col("submittedAt").cast("timestamp").alias("receivedAt"),
    )


def long_answers(events: DataFrame) -> DataFrame:
    return project(events, LONG_COLUMNS)


def page_visits(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'view'").select(F.lit("home").alias("page"), F.col("ts").alias("visited_at"))


def queue_lines(events: DataFrame) -> DataFrame:
    """Survey and contact messages with planted incomplete and unreadable ones."""
    answers = long_answers(events)
    kind = F.col("event_id") % 10
    seconds = F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    survey = F.to_json(F.struct(
        F.lit("survey").alias("type"), "question", "answer", seconds.alias("timestamp")))
    contact = F.to_json(F.struct(
        F.lit("contact").alias("type"),
        F.concat(F.lit("user"), F.col("event_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("answer").alias("message"), seconds.alias("timestamp")))
    lines = (
        F.when(kind == 1, contact)
        .when(kind == 2, F.lit("oops"))
        .when(kind == 3, F.lit("[1]"))
        .when(kind == 4, F.lit("{}"))
        .when(kind == 5, F.lit('{"type":"other"}'))
        .when(kind == 6, F.lit('{"type":"survey","question":"Pytanie 1"}'))
        .when(kind == 7, F.lit('{"type":"survey","question":"Pytanie 1","answer":5}'))
        .otherwise(survey)
    )
    return compute_once(answers, value=lines).select("value")


def samples(events: DataFrame) -> DataFrame:
    flat = project(events, SAMPLE_COLUMNS)
    return flat.select(
        "metric",
        F.create_map(F.lit("instance"), F.col("instance"), F.lit("mode"), F.lit("idle")).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"), "value",
    )


def cpu_samples(events: DataFrame) -> DataFrame:
    """Counters of processor seconds by mode, among samples of another metric."""
    flat = project(events, SAMPLE_COLUMNS)
    mode = F.when(F.col("metric") == "view", F.lit("idle")).when(F.col("metric") == "click", F.lit("user")).otherwise(F.lit("system"))
    return flat.select(
        F.when(F.col("metric") == "error", F.lit("node_load1")).otherwise(F.lit(CPU_SECONDS)).alias("metric"),
        F.create_map(F.lit("instance"), F.col("instance"), F.lit("mode"), mode).alias("labels"),
        F.col("ts").cast("timestamp").alias("ts"), "value",
    )


def log_entries(events: DataFrame) -> DataFrame:
    """Log entries; those of errors have a time that cannot be read, those of signups none."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp = F.when(F.col("event_type") == "error", F.lit("n/a")).when(F.col("event_type") != "signup", iso)
    return (
        project(events, {**LOG_COLUMNS, "event_type": "event_type"})
        .withColumn("timestamp", stamp)
        .withColumn("ingested_at", F.col("ts") + F.make_dt_interval(F.lit(1)))
    )


def pods(events: DataFrame) -> DataFrame:
    flat = project(events, POD_COLUMNS)
    meta = {r.MIRROR: "mirror", r.SCRAPE: "scrape", r.CONTAINER: "container", r.POD: "pod",
            r.NAMESPACE: "namespace", r.UID: "uid"}
    pairs = [c for name, column in meta.items() for c in (F.lit(name), F.col(column))]
    return flat.select("event_id", F.create_map(*pairs).alias("labels"))
