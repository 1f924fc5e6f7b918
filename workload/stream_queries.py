"""Streams over the same tables, run to the end of the data, and their stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.operators import kpi, logs, popularity, submissions, token_index
from canvass.session import work_dir
from canvass.sinks.tables import latest_per_key, overwrite, read_batches, read_snapshot
from canvass.sources.surveys import decode_events, valid_events
from canvass.sources.logs import Input, union_streams
from canvass.streaming import intake, late, queries, rates
from workload import fixtures as fx
from workload.batch_queries import (
    ANSWERS_JSON,
    HIST,
    LOGS,
    INDEX_NAME,
    LOG_TIME,
    QUEUE,
    S,
    SENTIMENT,
    STAMP,
    TREND_ROWS,
    WINDOW_STATS,
    _window_rows,
    _windows,
    surveys,
)
from workload.catalog import ORACLES, joined, query, r6, stamp

# messages keep times in milliseconds, and the submitting service's carry no session
J = f"""e AS ({fx.sql({**fx.SURVEY_COLUMNS, 'event_type': 'event_type'})}),
s AS (SELECT * REPLACE (date_trunc('milliseconds', submittedAt) AS submittedAt,
             CASE event_type WHEN 'click' THEN NULL ELSE sessionId END AS sessionId) FROM e)"""


def event_stream(spark, sf_dir) -> DataFrame:
    """Decoded submissions of the event table as a stream of messages."""
    return valid_events(decode_events(fx.event_messages(fx.event_table_stream(spark, sf_dir))))


def finish(query) -> None:
    """Wait for the end of the data; a failure of the query is raised here."""
    query.awaitTermination()


def folders(spark, name: str) -> tuple[str, str]:
    root = work_dir(spark, name)
    return f"{root}/out", f"{root}/checkpoints"


@query("stream_text", f"""
WITH {J}
SELECT surveyId AS "surveyId", userId AS "userId", architecture_suggestions AS suggestion,
       {STAMP.format('submittedAt')} AS "submittedAt",
       CAST(length(architecture_suggestions) AS INTEGER) AS suggestion_length,
       CAST(len(string_split(architecture_suggestions, ' ')) AS INTEGER) AS suggestion_words,
       CAST({SENTIMENT.format('architecture_suggestions')} AS DOUBLE) AS sentiment_score
FROM s WHERE architecture_suggestions IS NOT NULL""")
def stream_text(spark, sf_dir):
    out, checkpoints = folders(spark, "text")
    finish(queries.start_text(event_stream(spark, sf_dir), out, checkpoints))
    rows = read_batches(spark, f"{out}/text_analysis").drop("batch_id")
    return rows.withColumn("submittedAt", stamp("submittedAt"))


@query("stream_landing", f"""
WITH {J}
SELECT strftime(submittedAt, '%Y-%m-%d') AS submitted_date, surveyId AS "surveyId", count(*) AS submissions,
       count(DISTINCT sessionId) AS sessions, count(java_tech_interest) AS choices
FROM s GROUP BY 1, 2""")
def stream_landing(spark, sf_dir):
    """Landed by the file sink in columns and day folders."""
    out, checkpoints = folders(spark, "landing")
    finish(queries.start_landing(event_stream(spark, sf_dir), out, checkpoints))
    landed = spark.read.parquet(f"{out}/landed_surveys")
    day = F.date_format("submitted_date", "yyyy-MM-dd").alias("submitted_date")
    return landed.groupBy(day, "surveyId").agg(
        F.count("*").alias("submissions"),
        F.count_distinct("sessionId").alias("sessions"),
        F.count("java_tech_interest").alias("choices"),
    )


def _with_counts(windows):
    counts = F.col("rating_counts")
    return _windows(windows).withColumns({f"n{r}": counts[r] for r in range(6)}).drop("rating_counts")


RATING_SQL = f"""
WITH {J}, {_window_rows('5 minutes')}
SELECT {STAMP.format('start')} AS window_start, {STAMP.format("start + INTERVAL '5 minutes'")} AS window_end,
       {WINDOW_STATS}, {HIST}
FROM w GROUP BY start"""


@query("stream_rating_update", RATING_SQL)
def stream_rating_update(spark, sf_dir):
    out, checkpoints = folders(spark, "ratings")
    finish(queries.start_ratings(event_stream(spark, sf_dir), out, checkpoints))
    batches = read_batches(spark, f"{out}/rating_analysis")
    return _with_counts(latest_per_key(batches, ["window"]))


@query("stream_rating_append", RATING_SQL + """
HAVING start + INTERVAL '5 minutes' <= (SELECT max(submittedAt) FROM s WHERE spring_performance IS NOT NULL)
       - INTERVAL '10 minutes'""")
def stream_rating_append(spark, sf_dir):
    """Windows that ended before the watermark; the last ones are still open."""
    out, checkpoints = folders(spark, "final")
    given = event_stream(spark, sf_dir).filter(F.col("answers")["spring_performance"].isNotNull())
    finish(queries.start_final_ratings(given, out, checkpoints))
    return _with_counts(read_batches(spark, f"{out}/rating_final").drop("batch_id"))


@query("stream_tech_exact", f"""
WITH {J}, {TREND_ROWS}
SELECT technology_clean, count(*) AS total_votes, count(DISTINCT submittedAt) AS unique_sessions
FROM v GROUP BY 1""")
def stream_tech_exact(spark, sf_dir):
    out, checkpoints = folders(spark, "tech")
    finish(queries.start_popularity_partials(event_stream(spark, sf_dir), out, checkpoints))
    return popularity.merge_popularity(read_batches(spark, f"{out}/tech_partials"))


@query("stream_tech_votes", f"""
WITH {J}, {TREND_ROWS} SELECT technology_clean, count(*) AS total_votes FROM v GROUP BY 1""")
def stream_tech_votes(spark, sf_dir):
    """The exact column of the complete-mode table."""
    return _sketched(spark, sf_dir).drop("unique_sessions")


def _sketched(spark, sf_dir):
    out, checkpoints = folders(spark, "popularity")
    finish(queries.start_popularity(event_stream(spark, sf_dir), out, checkpoints))
    return read_snapshot(spark, f"{out}/tech_popularity")


@query("stream_tech_approx", f"""
WITH {J}, {TREND_ROWS} SELECT technology_clean, count(*) AS total_votes, true AS within_error FROM v GROUP BY 1""")
def stream_tech_approx(spark, sf_dir):
    """Sketched distinct counts beside exact ones; their stated deviation is 5 percent."""
    exact = popularity.tech_popularity(surveys(spark, sf_dir).withColumn("submittedAt", F.date_trunc("millisecond", "submittedAt")))
    exact = exact.select(F.col("technology_clean").alias("t"), F.col("unique_sessions").alias("exact"))
    both = _sketched(spark, sf_dir).join(exact, F.col("technology_clean") == F.col("t"))
    close = F.abs(F.col("unique_sessions") - F.col("exact")) <= 3 * 0.05 * F.col("exact")
    return both.select("technology_clean", "total_votes", close.alias("within_error"))


@query("stream_audit", f"""
WITH {J}
SELECT 'survey_event' AS type, surveyId AS "surveyId", userId AS "userId", sessionId AS "sessionId",
       {STAMP.format('submittedAt')} AS "submittedAt", {ANSWERS_JSON} AS answers_json FROM s""")
def stream_audit(spark, sf_dir):
    out, checkpoints = folders(spark, "audit")
    finish(queries.start_audit(event_stream(spark, sf_dir), out, checkpoints))
    rows = spark.read.parquet(f"{out}/spark_surveys").drop("@timestamp")
    return rows.withColumn("submittedAt", stamp("submittedAt"))


@query("stream_pipeline", f"""
WITH {J} SELECT 'text_analysis' AS output, count(*) AS n FROM s WHERE architecture_suggestions IS NOT NULL
UNION ALL SELECT 'rating_analysis', count(*) FROM s WHERE spring_performance IS NOT NULL
UNION ALL SELECT 'tech_popularity', sum(len(string_split(java_tech_interest, ',')))::BIGINT FROM s
UNION ALL SELECT 'spark_surveys', count(*) FROM s""")
def stream_pipeline(spark, sf_dir):
    """All four queries side by side; rows that went into each output."""
    out, checkpoints = folders(spark, "pipeline")
    for running in queries.start_all(event_stream(spark, sf_dir), out, checkpoints, once=True):
        finish(running)
    rated = latest_per_key(read_batches(spark, f"{out}/rating_analysis"), ["window"])
    votes = read_snapshot(spark, f"{out}/tech_popularity")
    parts = {
        "text_analysis": read_batches(spark, f"{out}/text_analysis").agg(F.count("*").alias("n")),
        "rating_analysis": rated.agg(F.sum("total_responses").alias("n")),
        "tech_popularity": votes.agg(F.sum("total_votes").alias("n")),
        "spark_surveys": spark.read.parquet(f"{out}/spark_surveys").agg(F.count("*").alias("n")),
    }
    rows = [df.select(F.lit(name).alias("output"), "n") for name, df in parts.items()]
    result = rows[0]
    for more in rows[1:]:
        result = result.unionAll(more)
    return result


@query("stream_event_intake", f"""
WITH {J}
SELECT 'landed' AS output, surveyId AS "surveyId", strftime(submittedAt, '%Y-%m-%d') AS "date", count(*) AS n
FROM s WHERE event_type <> 'signup' GROUP BY 2, 3
UNION ALL SELECT 'dead', NULL, NULL, count(*) FROM s WHERE event_type = 'signup'""")
def stream_event_intake(spark, sf_dir):
    """One decoding pass; messages of signups cannot be read."""
    out, checkpoints = folders(spark, "intake")
    messages = fx.event_messages(fx.event_table_stream(spark, sf_dir), planted=True)
    finish(intake.start_event_intake(messages, out, checkpoints))
    landed = read_batches(spark, f"{out}/survey_responses").groupBy(
        F.lit("landed").alias("output"), "surveyId",
        F.date_format("submitted_date", "yyyy-MM-dd").alias("date"),
    ).agg(F.count("*").alias("n"))
    dead = read_batches(spark, f"{out}/dead_letters").agg(F.count("*").alias("n"))
    return landed.unionAll(dead.select(
        F.lit("dead"), F.lit(None).cast("string"), F.lit(None).cast("string"), "n"))


@query("submission_fanout", f"""
WITH {S}, b AS (SELECT *, coalesce(architecture_suggestions, '') IN ('Super', 'problem z kolejką') AS refused FROM s)
SELECT unnest(CASE WHEN refused THEN ['refused'] ELSE ['survey_responses', 'survey_events', 'logs'] END) AS output,
       count(*) AS n FROM b GROUP BY 1""")
def submission_fanout(spark, sf_dir):
    """Each accepted body to three outputs."""
    out, checkpoints = folders(spark, "submissions")
    bodies = fx.request_bodies(fx.event_table_stream(spark, sf_dir))
    finish(intake.start_submissions(bodies, out, checkpoints))
    parts = [
        read_batches(spark, f"{out}/{name}").select(F.lit(name).alias("output"))
        for name in ("survey_responses", "survey_events", "logs", "refused")
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionAll(more)
    return rows.groupBy("output").agg(F.count("*").alias("n"))


@query("queue_router", f"""
WITH {QUEUE},
survey AS (SELECT CASE kind WHEN 7 THEN 'Pytanie 1' ELSE question END AS a, CASE kind WHEN 7 THEN '5' ELSE answer END AS b
           FROM z WHERE kind NOT IN (1, 2, 3, 4, 5, 6)),
bad AS (SELECT kind FROM z WHERE kind IN (3, 6))
SELECT 'survey_responses' AS output, a, b, count(*) AS n FROM survey GROUP BY ALL
UNION ALL SELECT 'contact_messages', 'user' || CAST(event_id AS VARCHAR) || '@example.com', answer, count(*)
          FROM z WHERE kind = 1 GROUP BY ALL
UNION ALL SELECT 'dead_letters', CASE kind WHEN 3 THEN '[1]' ELSE '{{"type":"survey","question":"Pytanie 1"}}' END,
          CASE kind WHEN 3 THEN 'not an object' ELSE 'answer missing' END, count(*) FROM bad GROUP BY ALL
UNION ALL SELECT 'forwarded', CASE kind WHEN 2 THEN '{{"raw":"oops","type":"unknown"}}' WHEN 4 THEN '{{}}'
          WHEN 5 THEN '{{"type":"other"}}' WHEN 6 THEN '{{"type":"survey","question":"Pytanie 1"}}'
          WHEN 7 THEN '{{"type":"survey","question":"Pytanie 1","answer":5}}'
          WHEN 1 THEN 'contact' ELSE 'survey' END, NULL, count(*) FROM z WHERE kind <> 3 GROUP BY ALL""")
def queue_router(spark, sf_dir):
    """Queue lines by destination; forwarded messages with a time are counted by type."""
    out, checkpoints = folders(spark, "router")
    lines = fx.queue_lines(fx.event_table_stream(spark, sf_dir))
    finish(intake.start_router(lines, out, checkpoints))

    def rows(name, a, b):
        return read_batches(spark, f"{out}/{name}").select(
            F.lit(name).alias("output"), a.alias("a"), b.alias("b"))

    timed = F.col("value").contains('"timestamp"')
    forwarded = F.when(timed, F.get_json_object("value", "$.type")).otherwise(F.col("value"))
    return (
        rows("survey_responses", F.col("question"), F.col("answer"))
        .unionAll(rows("contact_messages", F.col("email"), F.col("message")))
        .unionAll(rows("dead_letters", F.col("value"), F.col("problem")))
        .unionAll(rows("forwarded", forwarded, F.lit(None).cast("string")))
        .groupBy("output", "a", "b").agg(F.count("*").alias("n"))
    )


@query("visit_intake", "SELECT 'home' AS page, count(*) AS visits FROM events WHERE event_type = 'view'")
def visit_intake(spark, sf_dir):
    out, checkpoints = folders(spark, "visits")
    hits = fx.event_table_stream(spark, sf_dir).filter("event_type = 'view'")
    finish(intake.start_visits(hits, out, checkpoints))
    return read_batches(spark, f"{out}/page_visits").groupBy("page").agg(F.count("visited_at").alias("visits"))


@query("stream_log_routing", f"""
WITH {LOGS}, x AS (SELECT *, event_type IN ('error', 'signup') AS undated FROM g)
SELECT {INDEX_NAME} AS index_name, CASE WHEN NOT undated THEN strftime(ts, '%Y-%m-%d') END AS index_date,
       count(*) AS n FROM x GROUP BY ALL""")
def stream_log_routing(spark, sf_dir):
    """Index folders; entries without a readable time lie under the day of arrival."""
    out, checkpoints = folders(spark, "log_routing")
    entries = fx.log_entries(fx.event_table_stream(spark, sf_dir)).drop("ingested_at")
    finish(intake.start_log_routing(entries, out, checkpoints))
    stored = spark.read.parquet(f"{out}/log_index")
    dated = F.when(~F.col("event_type").isin("error", "signup"), F.date_format("index_date", "yyyy-MM-dd"))
    return stored.groupBy("index_name", dated.alias("index_date")).agg(F.count("*").alias("n"))


TYPED = f"""b AS (SELECT *, {fx.BODY_KIND} AS kind FROM s
WHERE coalesce(architecture_suggestions, '') NOT IN ('Super', 'problem z kolejką')),
v AS (SELECT trim(unnest(CASE kind WHEN 1 THEN string_split(java_tech_interest, ',') WHEN 2 THEN []
          ELSE string_split(rtrim(java_tech_interest, ','), ',') END)) AS technology
      FROM b WHERE java_tech_interest IS NOT NULL),
g AS (SELECT technology, count(*) AS votes FROM v GROUP BY 1)"""


@query("kpi_from_stored", f"""
WITH {S}, {TYPED}
SELECT (SELECT count(*) FROM b) AS "totalResponses", (SELECT count(DISTINCT sessionId) FROM b) AS "uniqueUsers",
       (SELECT string_agg(technology || '=' || CAST(votes AS VARCHAR), ';' ORDER BY technology) FROM g) AS "techPopularity",
       true AS same_as_fresh""")
def kpi_from_stored(spark, sf_dir):
    """Key figures of stored bodies, whose answers keep their JSON types, beside the fresh ones."""
    out, checkpoints = folders(spark, "typed")
    finish(intake.start_submissions(fx.request_bodies(fx.event_table_stream(spark, sf_dir)), out, checkpoints))

    def record(rows):
        return kpi.overview(rows).select(
            "totalResponses", "uniqueUsers", joined(F.map_entries("techPopularity"), ("key", "value")).alias("techPopularity"),
            F.struct("avgRating", joined("ratingsChart.data").alias("ratings")).alias("rated"))

    stored = record(read_batches(spark, f"{out}/survey_responses"))
    # figures and votes both read the rows, so the bodies are decoded once and kept beside the stored ones
    overwrite(submissions.normalise_submissions(fx.request_bodies(fx.spread_events(spark, sf_dir))), f"{out}/fresh")
    fresh = record(spark.read.parquet(f"{out}/fresh"))
    same = F.col("rated") == fresh.select("rated").scalar()
    return stored.select("totalResponses", "uniqueUsers", "techPopularity", same.alias("same_as_fresh"))


@query("queue_redelivered", f"""
WITH {QUEUE}, u AS (SELECT DISTINCT kind, CASE WHEN kind IN (0, 1, 8, 9) THEN event_id END AS event_id FROM z)
SELECT 'survey_responses' AS output, count(*) AS n FROM u WHERE kind IN (0, 7, 8, 9)
UNION ALL SELECT 'contact_messages', count(*) FROM u WHERE kind = 1
UNION ALL SELECT 'dead_letters', count(*) FROM u WHERE kind IN (3, 6)
UNION ALL SELECT 'forwarded', count(*) FROM u WHERE kind <> 3""")
def queue_redelivered(spark, sf_dir):
    """Each fifth line comes again in the next micro-batch, and is stored once; lines of equal text are one message."""
    out, checkpoints = folders(spark, "redelivered")
    lines = fx.queue_lines(fx.event_table_stream(spark, sf_dir, again=5))
    finish(intake.start_router(lines, out, checkpoints, redelivery="10 minutes"))
    rows = [read_batches(spark, f"{out}/{name}").select(F.lit(name).alias("output"))
            for name in ("survey_responses", "contact_messages", "dead_letters", "forwarded")]
    return rows[0].unionAll(rows[1]).unionAll(rows[2]).unionAll(rows[3]).groupBy("output").agg(F.count("*").alias("n"))


@query("stream_late_rows", f"""
WITH e AS (SELECT event_id, event_type, ts, epoch_us(ts) - min(epoch_us(ts)) OVER () AS since,
   max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1 AS span FROM events),
b AS (SELECT *, least(floor((since + CASE WHEN event_id % 7 = 0 THEN 300000000 ELSE 0 END) * {fx.FILES} / span), {fx.FILES - 1}) AS batch FROM e),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b GROUP BY batch)
SELECT coalesce(ts < before - INTERVAL 1 MINUTE, false) AS late, event_type, count(*) AS n, sum(event_id) AS ids
FROM b JOIN m USING (batch) GROUP BY ALL""")
def stream_late_rows(spark, sf_dir):
    """Rows that a watermark of one minute would drop are stored beside the others."""
    out, checkpoints = folders(spark, "late_rows")
    finish(late.start_keeping_late(fx.event_table_stream(spark, sf_dir), out, checkpoints, "events", "ts", "1 minute"))
    rows = read_batches(spark, f"{out}/events").withColumn("late", F.lit(False)).unionByName(
        read_batches(spark, f"{out}/events_late").withColumn("late", F.lit(True)))
    return rows.groupBy("late", "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("stream_token_index", f"""
WITH {LOGS} SELECT strftime(CAST({LOG_TIME} AS DATE), '%Y-%m-%d') AS day, count(*) AS docs FROM g
WHERE list_has_any(regexp_split_to_array(lower(message), '[^\\p{{L}}\\p{{N}}]+'), ['v2', 'missing']) GROUP BY 1""")
def stream_token_index(spark, sf_dir):
    """Log messages indexed by word as they arrive; matches of each day from the postings alone."""
    out, checkpoints = folders(spark, "token_index")
    entries = logs.normalise_time(fx.log_entries(fx.event_table_stream(spark, sf_dir)))
    finish(intake.start_token_index(entries, out, checkpoints, doc="event_id", text="message", day="@timestamp"))
    found = token_index.hits_by_day(spark, f"{out}/token_index", "v2 MISSING")
    return found.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "docs")


@query("stream_counter_rate", ORACLES["counter_rate_5m"])
def stream_counter_rate(spark, sf_dir):
    """The rates of four micro-batches, late samples among them, are those of the whole table."""
    out, checkpoints = folders(spark, "rates")
    finish(rates.start_rates(fx.samples(fx.event_table_stream(spark, sf_dir)), out, checkpoints))
    found = rates.read_rates(spark, out)
    return found.select("metric", F.col("labels")["instance"].alias("instance"), stamp("ts").alias("ts"), "value", r6("rate").alias("rate"))


@query("stream_log_union", f"""
WITH {LOGS}, x AS (SELECT level, NULL AS role, ts FROM g UNION ALL SELECT NULL, event_type, ts FROM events UNION ALL SELECT 'PAGE', NULL, ts FROM events WHERE event_type = 'view')
SELECT level, role, count(*) AS n FROM x GROUP BY ALL""")
def stream_log_union(spark, sf_dir):
    """Log entries, events and page views as three streams of one query; a last row of each closes all windows."""
    out, checkpoints = folders(spark, "log_union")
    entries = fx.log_entries(fx.event_table_stream(spark, sf_dir, closing=True)).select("level", F.col("ts").alias("at"))
    events = fx.event_table_stream(spark, sf_dir, closing=True).select(F.col("event_type").alias("role"), F.col("ts").alias("happened"))
    pages = fx.event_table_stream(spark, sf_dir, closing=True).filter("event_type IN ('view', 'closing')").select(
        F.lit("PAGE").alias("level"), "ts")
    whole = union_streams(Input(entries, "at", "10 minutes"), Input(events, "happened", "10 minutes"), Input(pages, "ts", "10 minutes"))
    finish(queries.start_log_counts(whole.select("level", "role", "event_time"), out, checkpoints))
    return read_batches(spark, f"{out}/log_counts").groupBy("level", "role").agg(F.sum("n").alias("n"))
