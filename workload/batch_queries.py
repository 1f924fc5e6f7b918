"""Reports, statistics and lookups over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from canvass.operators import (
    finders,
    kpi,
    logs,
    longform,
    popularity,
    ratings,
    relabel,
    reports,
    samples,
    submissions,
    text_features,
    token_index,
)
from canvass.functions.scales import DESCENDING, rating
from canvass.functions.stats import pearson
from canvass.plans.batch_report import land_surveys, read_reports, run_batch_report, write_reports
from canvass.plans.incremental import refresh_reports
from canvass.session import work_dir
from canvass.sinks.ledger import current_states
from canvass.sinks.messages import submission_messages
from canvass.sinks.tables import write_partitioned
from canvass.sources import evolving
from canvass.sources.catalogue import FALLBACK_SURVEY, SITE_SURVEY, TECHNOLOGY_SURVEY, catalogue
from canvass.sources.logs import newest_hits, read_log_index, union_intake
from canvass.sources.queue import decode_messages
from workload import fixtures as fx
from workload.catalog import ORACLES, day, joined, query, r6, stamp

S = f"s AS ({fx.sql(fx.SURVEY_COLUMNS)})"
L = f"l AS ({fx.sql(fx.LONG_COLUMNS)})"

DOWN = ("CASE WHEN contains({0}, '5') THEN 5 WHEN contains({0}, '4') THEN 4 WHEN contains({0}, '3') THEN 3 "
        "WHEN contains({0}, '2') THEN 2 WHEN contains({0}, '1') THEN 1 ELSE 0 END")
UP = ("CASE WHEN contains({0}, '1') THEN 1 WHEN contains({0}, '2') THEN 2 WHEN contains({0}, '3') THEN 3 "
      "WHEN contains({0}, '4') THEN 4 WHEN contains({0}, '5') THEN 5 ELSE 0 END")
SENTIMENT = ("CASE WHEN regexp_matches({0}, 'dobr|super|świetn') THEN 1.0 "
             "WHEN regexp_matches({0}, 'kieps|słab|problem') THEN -1.0 ELSE 0.0 END")
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
DAY = "strftime({0}, '%Y-%m-%d')"


def surveys(spark, sf_dir):
    return fx.surveys(fx.table(spark, sf_dir, "events"))


def documents_of(spark, sf_dir):
    return fx.with_answer_map(surveys(spark, sf_dir))


def answers(spark, sf_dir):
    return fx.long_answers(fx.table(spark, sf_dir, "events"))


# --- reports ---------------------------------------------------------------------------

@query("daily_stats", f"""
WITH {S}
SELECT {DAY.format('submittedAt')} AS "date", count(*) AS total_submissions,
       count(DISTINCT userId) AS unique_users, count(DISTINCT sessionId) AS unique_sessions,
       round(avg({DOWN.format('spring_performance')}), 6) AS avg_rating
FROM s GROUP BY 1""")
def daily_stats(spark, sf_dir):
    out = reports.daily_stats(surveys(spark, sf_dir))
    return out.withColumns({"date": day("date"), "avg_rating": r6("avg_rating")})


@query("hourly_report", f"""
WITH {S}
SELECT CAST(hour(submittedAt) AS INTEGER) AS "hour", count(*) AS submissions,
       count(DISTINCT userId) AS users,
       round(avg(CASE WHEN contains(spring_performance, '5') THEN 5
                      WHEN contains(spring_performance, '4') THEN 4 ELSE 3 END), 6) AS avg_rating
FROM s GROUP BY 1""")
def hourly_report(spark, sf_dir):
    return reports.hourly_report(surveys(spark, sf_dir)).withColumn("avg_rating", r6("avg_rating"))


TREND_ROWS = """v AS (SELECT submittedAt, trim(unnest(string_split(java_tech_interest, ','))) AS technology_clean
FROM s WHERE java_tech_interest IS NOT NULL)"""


@query("tech_trends", f"""
WITH {S}, {TREND_ROWS}
SELECT {DAY.format('submittedAt')} AS "date", technology_clean, count(*) AS daily_votes
FROM v GROUP BY 1, 2""")
def tech_trends(spark, sf_dir):
    return reports.tech_trends(surveys(spark, sf_dir)).withColumn("date", day("date"))


def _correlations(elk: str) -> str:
    def safe(a, b):
        return f"round(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 6)"

    return f"""
WITH {S}, x AS (SELECT {DOWN.format('spring_performance')} AS p, {DOWN.format('integration_quality')} AS i,
                       {elk} AS e FROM s)
SELECT {safe('p', 'i')} AS spring_integration_corr, {safe('p', 'e')} AS spring_elk_corr,
       {safe('i', 'e')} AS integration_elk_corr FROM x"""


def _rounded(df):
    return df.select(*[r6(c).alias(c) for c in df.columns])


@query("answer_correlations", _correlations(
    "CASE WHEN elk_usefulness LIKE '%Tak, zdecydowanie%' THEN 2 WHEN elk_usefulness LIKE '%Raczej tak%' THEN 1 "
    "WHEN elk_usefulness LIKE '%Raczej nie%' THEN -1 WHEN elk_usefulness LIKE '%Nie%' THEN -2 ELSE 0 END"))
def answer_correlations(spark, sf_dir):
    return _rounded(reports.answer_correlations(surveys(spark, sf_dir)))


@query("answer_correlations_exact_choice", _correlations(
    "CASE elk_usefulness WHEN 'Tak, zdecydowanie' THEN 2 WHEN 'Raczej tak' THEN 1 "
    "WHEN 'Raczej nie' THEN -1 WHEN 'Nie' THEN -2 ELSE 0 END"))
def answer_correlations_exact_choice(spark, sf_dir):
    return _rounded(reports.answer_correlations(surveys(spark, sf_dir), match="exact"))


SUMMARY = f"""
WITH {S}
SELECT count(DISTINCT CAST(submittedAt AS DATE)) AS total_days, count(DISTINCT hour(submittedAt)) AS total_hours,
       round(corr({DOWN.format('spring_performance')}, {DOWN.format('integration_quality')}), 6) AS avg_correlation
FROM s"""


@query("report_summary", SUMMARY)
def report_summary(spark, sf_dir):
    frame = surveys(spark, sf_dir)
    summary = reports.run_summary(
        reports.daily_stats(frame), reports.hourly_report(frame), reports.answer_correlations(frame))
    return summary.withColumn("avg_correlation", r6("avg_correlation"))


@query("pearson_with_gaps", f"""
WITH {S}, x AS (SELECT CASE WHEN spring_performance IS NOT NULL THEN {DOWN.format('spring_performance')} END AS p,
                       CASE WHEN integration_quality IS NOT NULL THEN {DOWN.format('integration_quality')} END AS i FROM s)
SELECT round(corr(p, i), 6) AS correlation FROM x""")
def pearson_with_gaps(spark, sf_dir):
    """Missing answers are NULL here, not 0, and leave their row out."""
    def score(c):
        return F.when(F.col(c).isNotNull(), rating(F.col(c), DESCENDING)).alias(c)

    scored = surveys(spark, sf_dir).select(score("spring_performance"), score("integration_quality"))
    return scored.agg(r6(pearson("spring_performance", "integration_quality")).alias("correlation"))


def stored_report(spark, sf_dir, name):
    """A table of the batch job, read back from where it was stored."""
    out = work_dir(spark, "batch_report")
    write_reports(land_surveys(documents_of(spark, sf_dir), f"{out}/landed"), out)
    return read_reports(spark, out)[name]


@query("batch_report_daily", ORACLES["daily_stats"])
def batch_report_daily(spark, sf_dir):
    out = stored_report(spark, sf_dir, "daily_stats")
    return out.withColumns({"date": day("date"), "avg_rating": r6("avg_rating")})


@query("batch_report_hourly", ORACLES["hourly_report"])
def batch_report_hourly(spark, sf_dir):
    return stored_report(spark, sf_dir, "hourly_report").withColumn("avg_rating", r6("avg_rating"))


@query("batch_report_trends", ORACLES["tech_trends"])
def batch_report_trends(spark, sf_dir):
    return stored_report(spark, sf_dir, "tech_trends").withColumn("date", day("date"))


@query("batch_report_correlations", ORACLES["answer_correlations"])
def batch_report_correlations(spark, sf_dir):
    return _rounded(stored_report(spark, sf_dir, "correlations"))


def _in_two_runs(spark, sf_dir, exact):
    """Reports of the landed events, refreshed after each half of them arrived; the days they share are counted again."""
    out = work_dir(spark, "refreshed")
    rows = fx.surveys(fx.spread_events(spark, sf_dir))
    documents = fx.with_answer_map(rows)
    # any time near the middle will do; the exact one would gather all times in one task, for each landing again
    micros = F.unix_micros(F.col("submittedAt").cast("timestamp"))
    middle = F.lit(fx.surveys(fx.table(spark, sf_dir, "events")).agg(F.percentile_approx(micros, 0.5)).first()[0])
    first = F.unix_micros(F.col("submittedAt").cast("timestamp")) < middle
    land_surveys(documents.filter(first), f"{out}/landed")
    refresh_reports(spark, f"{out}/landed", out, exact)
    # a landing replaces its days, so the day that was cut lands whole
    cut = F.to_date(F.timestamp_micros(middle))
    land_surveys(documents.filter(F.to_date("submittedAt") >= cut), f"{out}/landed")
    refresh_reports(spark, f"{out}/landed", out, exact)
    return read_reports(spark, out)


@query("refreshed_daily", ORACLES["daily_stats"])
def refreshed_daily(spark, sf_dir):
    return _in_two_runs(spark, sf_dir, True)["daily_stats"].withColumns({"date": day("date"), "avg_rating": r6("avg_rating")})


@query("refreshed_hourly", ORACLES["hourly_report"])
def refreshed_hourly(spark, sf_dir):
    return _in_two_runs(spark, sf_dir, True)["hourly_report"].withColumn("avg_rating", r6("avg_rating"))


@query("refreshed_sketches", f"""
WITH {S}, d AS (SELECT CAST(submittedAt AS DATE) AS date, count(DISTINCT "userId") AS users, count(DISTINCT "sessionId") AS sessions FROM s GROUP BY 1)
SELECT strftime(date, '%Y-%m-%d') AS date, true AS users_close, true AS sessions_close FROM d""")
def refreshed_sketches(spark, sf_dir):
    """Distinct people from stored sketches, within four standard errors of the exact counts."""
    sketched = _in_two_runs(spark, sf_dir, False)["daily_stats"]
    exact = reports.daily_stats(surveys(spark, sf_dir)).select(F.col("date").alias("d"), F.col("unique_users").alias("u"), F.col("unique_sessions").alias("s"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(1.0), 4 * 1.04 / 128 * F.col(b))
    return sketched.join(exact, F.col("date").eqNullSafe(F.col("d"))).select(
        day("date").alias("date"), close("unique_users", "u").alias("users_close"), close("unique_sessions", "s").alias("sessions_close"))


@query("landed_projection", f"""
WITH {S}
SELECT surveyId AS "surveyId", count(*) AS n, count(spring_performance) AS rated, count(java_tech_interest) AS chosen
FROM s GROUP BY 1""")
def landed_projection(spark, sf_dir):
    """Landed submissions keep every answer, so all readers of documents can go on from them."""
    out = work_dir(spark, "landed")
    landed = land_surveys(documents_of(spark, sf_dir), out)
    answers_of = finders.analytics_projection(landed.filter("surveyId IS NOT NULL").select("answers", "submittedAt", "surveyId"))
    assert answers_of.columns == ["answers", "submittedAt"]
    return landed.groupBy("surveyId").agg(
        F.count("*").alias("n"), F.count(F.col("answers")["spring_performance"]).alias("rated"),
        F.count(F.col("answers")["java_tech_interest"]).alias("chosen"))


@query("landed_new_answers", f"""
WITH {S}, x AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'track' || CAST(event_id % 4 AS VARCHAR) END AS track, submittedAt FROM s)
SELECT track, count(*) AS n, count(DISTINCT CAST(submittedAt AS DATE)) AS days FROM x GROUP BY 1""")
def landed_new_answers(spark, sf_dir):
    """An answer becomes frequent in the second landing; rows of both landings give it as one column."""
    path = work_dir(spark, "evolving")
    number = F.expr("'track' || CAST(event_id % 4 AS STRING)")
    documents = documents_of(spark, sf_dir).withColumn("track", F.when(F.col("event_id") % 2 == 0, number))
    whole = documents.withColumn("answers", F.map_concat("answers", F.map_filter(F.create_map(F.lit("track"), "track"), lambda _, v: v.isNotNull()))).drop("track")
    day_number = F.dense_rank().over(Window.orderBy("d"))
    days = whole.select(F.to_date("submittedAt").alias("d")).distinct().select("d", (day_number % 2).alias("turn"))
    turn = whole.withColumn("d", F.to_date("submittedAt")).join(F.broadcast(days), "d").drop("d")  # a row for each day
    evolving.land_evolving(turn.filter("turn = 0").drop("turn"), path, share=0.99)  # not frequent enough yet
    landed = evolving.land_evolving(turn.filter("turn = 1").drop("turn"), path, share=0.2)
    return landed.groupBy("track").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("submittedAt")).alias("days"))


@query("batch_report_run", SUMMARY.replace("AS avg_correlation", """AS avg_correlation,
       'COMPLETED' AS status, strftime(max(submittedAt), '%Y-%m-%d %H:%M:%S.%f') AS data_end"""))
def batch_report_run(spark, sf_dir):
    """The whole job on documents: landing, four tables, report, ledger."""
    out = work_dir(spark, "batch_report")
    run_batch_report(documents_of(spark, sf_dir), out, land_to=f"{out}/landed")
    ledger = current_states(spark.read.parquet(f"{out}/spark_analytics"))
    result = F.col("results")
    return ledger.select(
        result["total_days"].cast("bigint").alias("total_days"),
        result["total_hours"].cast("bigint").alias("total_hours"),
        r6(result["avg_correlation"].cast("double")).alias("avg_correlation"),
        "status", stamp("dataEndTime").alias("data_end"),
    )


# --- texts -----------------------------------------------------------------------------

@query("text_sentiment", f"""
WITH {S}
SELECT surveyId AS "surveyId", userId AS "userId", architecture_suggestions AS suggestion,
       {STAMP.format('submittedAt')} AS "submittedAt",
       CAST(length(architecture_suggestions) AS INTEGER) AS suggestion_length,
       CAST(len(string_split(architecture_suggestions, ' ')) AS INTEGER) AS suggestion_words,
       CAST({SENTIMENT.format('architecture_suggestions')} AS DOUBLE) AS sentiment_score
FROM s WHERE architecture_suggestions IS NOT NULL""")
def text_sentiment(spark, sf_dir):
    return text_features.text_analysis(surveys(spark, sf_dir)).withColumn("submittedAt", stamp("submittedAt"))


@query("doc_text_features", f"""
SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length,
       CAST(len(string_split(text, ' ')) AS INTEGER) AS text_words,
       CAST({SENTIMENT.format('text')} AS DOUBLE) AS sentiment_score
FROM documents""")
def doc_text_features(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_features.with_text_features(docs, "text", "text").drop("text")


# --- ratings ---------------------------------------------------------------------------

def _window_rows(width: str) -> str:
    return f"""w AS (SELECT time_bucket(INTERVAL '{width}', submittedAt) AS start,
{UP.format('spring_performance')} AS r FROM s WHERE spring_performance IS NOT NULL)"""


WINDOW_STATS = ("count(*) AS total_responses, round(avg(r), 6) AS avg_rating, "
                "round(stddev_samp(r), 6) AS rating_stddev")


def _windows(df):
    return df.withColumns({
        "window_start": stamp("window.start"), "window_end": stamp("window.end"),
        "avg_rating": r6("avg_rating"), "rating_stddev": r6("rating_stddev"),
    }).drop("window")


@query("rating_windows", f"""
WITH {S}, {_window_rows('5 minutes')}
SELECT {STAMP.format('start')} AS window_start, {STAMP.format("start + INTERVAL '5 minutes'")} AS window_end,
       0 AS page, {WINDOW_STATS},
       string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) AS all_ratings
FROM w GROUP BY start""")
def rating_windows(spark, sf_dir):
    values = ratings.rating_values(ratings.rating_windows(surveys(spark, sf_dir)))
    return _windows(values).withColumn("all_ratings", joined("all_ratings"))


@query("rating_windows_paged", f"""
WITH {S}, {_window_rows('1 day')},
n AS (SELECT start, r, (row_number() OVER (PARTITION BY start ORDER BY r) - 1) // 100 AS page FROM w),
a AS (SELECT start, {WINDOW_STATS} FROM w GROUP BY start)
SELECT {STAMP.format('n.start')} AS window_start, {STAMP.format("n.start + INTERVAL '1 day'")} AS window_end,
       CAST(page AS INTEGER) AS page, any_value(total_responses) AS total_responses,
       any_value(avg_rating) AS avg_rating, any_value(rating_stddev) AS rating_stddev,
       string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) AS all_ratings
FROM n JOIN a ON n.start = a.start GROUP BY n.start, page""")
def rating_windows_paged(spark, sf_dir):
    """Windows of a day, their ratings in lists of 100."""
    windows = ratings.rating_windows(surveys(spark, sf_dir), "1 day")
    return _windows(ratings.rating_values(windows, 100)).withColumn("all_ratings", joined("all_ratings"))


HIST = ", ".join(f"count(*) FILTER (r = {r}) AS n{r}" for r in ratings.RATINGS)


@query("rating_windows_hist", f"""
WITH {S}, {_window_rows('5 minutes')}
SELECT {STAMP.format('start')} AS window_start, {STAMP.format("start + INTERVAL '5 minutes'")} AS window_end,
       {WINDOW_STATS}, {HIST}
FROM w GROUP BY start""")
def rating_windows_hist(spark, sf_dir):
    out = _windows(ratings.rating_windows(surveys(spark, sf_dir)))
    return out.withColumns({f"n{r}": F.col("rating_counts")[r] for r in ratings.RATINGS}).drop("rating_counts")


@query("rating_distribution", f"""
WITH {S}, g AS (SELECT {UP.format('spring_performance')} AS r, count(*) AS n FROM s
                WHERE spring_performance IS NOT NULL GROUP BY 1)
SELECT CAST(x AS VARCHAR) AS label, coalesce(n, 0) AS responses
FROM (SELECT unnest([1, 2, 3, 4, 5]) AS x) LEFT JOIN g ON r = x""")
def rating_distribution(spark, sf_dir):
    return ratings.rating_distribution(surveys(spark, sf_dir))


# --- technologies ----------------------------------------------------------------------

@query("tech_popularity", f"""
WITH {S}, {TREND_ROWS}
SELECT technology_clean, count(*) AS total_votes, count(DISTINCT submittedAt) AS unique_sessions
FROM v GROUP BY 1""")
def tech_popularity(spark, sf_dir):
    return reports.newest_first(popularity.tech_popularity(surveys(spark, sf_dir)))


# the body's technologies: 1 list, 2 number, else text
BODIES = f"""b AS (SELECT *, {fx.BODY_KIND} AS kind FROM s
WHERE coalesce(architecture_suggestions, '') NOT IN ('Super', 'problem z kolejką'))"""


@query("tech_popularity_typed", f"""
WITH {S}, {BODIES},
v AS (SELECT trim(unnest(CASE kind WHEN 1 THEN string_split(java_tech_interest, ',') WHEN 2 THEN []
          ELSE string_split(rtrim(java_tech_interest, ','), ',') END)) AS technology
      FROM b WHERE java_tech_interest IS NOT NULL)
SELECT technology, count(*) AS votes FROM v GROUP BY 1""")
def tech_popularity_typed(spark, sf_dir):
    bodies = fx.request_bodies(fx.table(spark, sf_dir, "events"))
    return kpi.list_aware_votes(submissions.normalise_submissions(bodies))


JAVA_VOTES = """v AS (SELECT trim(unnest(string_split(rtrim(java_tech_interest, ','), ','))) AS technology
FROM s WHERE java_tech_interest IS NOT NULL),
g AS (SELECT technology, count(*) AS votes FROM v GROUP BY 1)"""


@query("tech_chart_series", f"""
WITH {S}, {JAVA_VOTES}
SELECT 'technologies' AS chart, 0 AS page, string_agg(technology, ',' ORDER BY technology) AS labels,
       string_agg(CAST(votes AS VARCHAR), ',' ORDER BY technology) AS data FROM g""")
def tech_chart_series(spark, sf_dir):
    series = kpi.chart_series(kpi.list_aware_votes(surveys(spark, sf_dir)))
    return series.withColumns({"labels": joined("labels"), "data": joined("data")})


@query("tech_chart_paged", f"""
WITH {S}, {JAVA_VOTES},
r AS (SELECT *, (row_number() OVER (ORDER BY technology) - 1) // 3 AS page FROM g)
SELECT 'technologies' AS chart, CAST(page AS INTEGER) AS page, string_agg(technology, ',' ORDER BY technology) AS labels,
       string_agg(CAST(votes AS VARCHAR), ',' ORDER BY technology) AS data FROM r GROUP BY page""")
def tech_chart_paged(spark, sf_dir):
    series = kpi.chart_series(kpi.list_aware_votes(surveys(spark, sf_dir)), 3)
    return series.withColumns({"labels": joined("labels"), "data": joined("data")})


@query("kpi_overview_paged", f"""
WITH {S}, {JAVA_VOTES},
r AS (SELECT *, CAST((row_number() OVER (ORDER BY technology) - 1) // 3 AS INTEGER) AS page FROM g)
SELECT page, CASE WHEN page = 0 THEN (SELECT count(*) FROM s) END AS "totalResponses",
       string_agg(technology || '=' || CAST(votes AS VARCHAR), ';' ORDER BY technology) AS "techPopularity"
FROM r GROUP BY page""")
def kpi_overview_paged(spark, sf_dir):
    record = kpi.overview(documents_of(spark, sf_dir), 3)
    return record.select("page", "totalResponses", joined(F.map_entries("techPopularity"), ("key", "value")).alias("techPopularity"))


@query("kpi_overview", f"""
WITH {S}, {JAVA_VOTES},
k AS (SELECT count(*) AS n, floor(avg(CASE WHEN spring_performance IS NOT NULL
             THEN {UP.format('spring_performance')} END) * 10 + 0.5) / 10 AS rating,
             count(DISTINCT sessionId) AS sessions,
             {", ".join(f"count(*) FILTER (spring_performance IS NOT NULL AND ({UP.format('spring_performance')}) = {r}) AS n{r}" for r in ratings.RATINGS[1:])}
      FROM s)
SELECT n AS "totalResponses", rating AS "avgRating", sessions AS "uniqueUsers", 0 AS page,
       (SELECT string_agg(technology || '=' || CAST(votes AS VARCHAR), ';' ORDER BY technology) FROM g) AS "techPopularity",
       concat_ws(',', n1, n2, n3, n4, n5) AS "ratingsChart"
FROM k""")
def kpi_overview(spark, sf_dir):
    record = kpi.overview(documents_of(spark, sf_dir))
    return record.select(
        "totalResponses", "avgRating", "uniqueUsers", "page",
        joined(F.map_entries("techPopularity"), ("key", "value")).alias("techPopularity"),
        joined("ratingsChart.data").alias("ratingsChart"),
    )


# --- long form -------------------------------------------------------------------------

@query("answer_counts", f"""
WITH {L} SELECT question, answer, count(*) AS "count" FROM l GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2""")
def answer_counts(spark, sf_dir):
    return longform.counts_in_order(longform.answer_counts(answers(spark, sf_dir)))


@query("clean_answer_counts", f"""
WITH {L} SELECT question, trim(answer) AS answer, count(*) AS "count" FROM l
WHERE trim(answer) <> '' GROUP BY 1, 2""")
def clean_answer_counts(spark, sf_dir):
    return longform.answer_counts(longform.clean_answers(answers(spark, sf_dir)))


@query("answers_nested", f"""
WITH {L}, c AS (SELECT question, answer, count(*) AS n FROM l GROUP BY 1, 2)
SELECT question, 0 AS page, string_agg(answer || '=' || CAST(n AS VARCHAR), ';' ORDER BY n DESC, answer) AS answers
FROM c GROUP BY 1""")
def answers_nested(spark, sf_dir):
    nested = longform.answers_nested(longform.answer_counts(answers(spark, sf_dir)))
    return nested.withColumn("answers", joined("answers", ("answer", "count")))


@query("answers_nested_paged", f"""
WITH {L}, c AS (SELECT question, answer, count(*) AS n FROM l GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (PARTITION BY question ORDER BY n DESC, answer) - 1) // 3 AS page FROM c)
SELECT question, CAST(page AS INTEGER) AS page,
       string_agg(answer || '=' || CAST(n AS VARCHAR), ';' ORDER BY n DESC, answer) AS answers
FROM r GROUP BY 1, 2""")
def answers_nested_paged(spark, sf_dir):
    """Three answers to a page, pages in the order of the whole list."""
    nested = longform.answers_nested(longform.answer_counts(answers(spark, sf_dir)), 3)
    return nested.withColumn("answers", joined("answers", ("answer", "count")))


@query("visit_total", "SELECT count(*) AS total_visits FROM events WHERE event_type = 'view'")
def visit_total(spark, sf_dir):
    return longform.visit_total(fx.page_visits(fx.table(spark, sf_dir, "events")))


@query("distinct_answer_pairs", f"""
WITH {L} SELECT count(*) AS total_responses FROM (SELECT DISTINCT question, answer FROM l)""")
def distinct_answer_pairs(spark, sf_dir):
    return longform.distinct_answer_pairs(longform.answer_counts(answers(spark, sf_dir)))


@query("survey_totals", f"""
WITH {L} SELECT (SELECT count(*) FROM events WHERE event_type = 'view') AS total_visits,
(SELECT count(*) FROM (SELECT DISTINCT question, answer FROM l)) AS total_responses""")
def survey_totals(spark, sf_dir):
    counts = longform.answer_counts(answers(spark, sf_dir))
    return longform.survey_totals(counts, fx.page_visits(fx.table(spark, sf_dir, "events")))


@query("chart_labels", f"""
WITH {L} SELECT question || ': ' || answer AS label, count(*) AS data FROM l GROUP BY question, answer""")
def chart_labels(spark, sf_dir):
    return longform.chart_labels(longform.answer_counts(answers(spark, sf_dir)))


CATALOGUE = ", ".join(f"('{q[0]}', '{q[1]}')" for q in TECHNOLOGY_SURVEY)


@query("answer_map_to_rows", f"""
WITH {S}, q(id, text) AS (VALUES {CATALOGUE}),
u AS (UNPIVOT s ON spring_performance, java_tech_interest, integration_quality, elk_usefulness,
      architecture_suggestions INTO NAME k VALUE answer)
SELECT surveyId AS "surveyId", sessionId AS "sessionId", k AS "questionId", coalesce(text, '') AS question, answer,
       strftime(submittedAt, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(millisecond(submittedAt) % 1000 AS VARCHAR), 3, '0')
       || 'Z' AS "timestamp", 'java-survey' AS "surveyType"
FROM u LEFT JOIN q ON q.id = u.k""")
def answer_map_to_rows(spark, sf_dir):
    return submissions.answer_rows(documents_of(spark, sf_dir), catalogue(spark))


@query("answers_with_question", f"""
WITH {L}, q(id, text) AS (VALUES {CATALOGUE}),
a AS (SELECT event_id, answer, CASE question WHEN 'Pytanie 1' THEN 'spring_performance'
      WHEN 'Pytanie 2' THEN 'java_tech_interest' WHEN 'Pytanie 3' THEN 'integration_quality'
      ELSE question END AS k FROM l)
SELECT event_id, answer, k AS "questionId", coalesce(text, '') AS question FROM a LEFT JOIN q ON q.id = a.k""")
def answers_with_question(spark, sf_dir):
    key = (F.when(F.col("question") == "Pytanie 1", "spring_performance")
           .when(F.col("question") == "Pytanie 2", "java_tech_interest")
           .when(F.col("question") == "Pytanie 3", "integration_quality").otherwise(F.col("question")))
    keyed = answers(spark, sf_dir).select("event_id", "answer", key.alias("questionId"))
    return longform.answers_with_question(keyed, catalogue(spark))


def _values(questions) -> str:
    return ", ".join("('" + "', '".join(q[:2]) + "')" for q in questions)


def _lookup_sql(questions) -> str:
    return f"""
WITH q(id, text) AS (VALUES {_values(questions)}), a AS (SELECT event_type AS answer, event_id % 7 AS k FROM events)
SELECT coalesce(text, '') AS question, answer, count(*) AS n FROM a LEFT JOIN q ON q.id = CAST(k AS VARCHAR) GROUP BY 1, 2"""


def _lookup(spark, sf_dir, questions):
    """Answers by number of the question, two of seven unknown."""
    keyed = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("answer"), (F.col("event_id") % 7).alias("questionId"))
    found = longform.answers_with_question(keyed, catalogue(spark, questions))
    return found.groupBy("question", "answer").agg(F.count("*").alias("n"))


@query("site_question_lookup", _lookup_sql(SITE_SURVEY))
def site_question_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir, SITE_SURVEY)


@query("fallback_question_lookup", _lookup_sql(FALLBACK_SURVEY))
def fallback_question_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir, FALLBACK_SURVEY)


# --- lookups ---------------------------------------------------------------------------

@query("responses_by_survey", f"""
WITH {S} SELECT event_id, sessionId AS "sessionId" FROM s WHERE surveyId = 'survey_v1'""")
def responses_by_survey(spark, sf_dir):
    return finders.by_survey(surveys(spark, sf_dir), "survey_v1").select("event_id", "sessionId")


@query("responses_in_range", f"""
WITH {S} SELECT event_id, {STAMP.format('submittedAt')} AS "submittedAt" FROM s
WHERE submittedAt >= TIMESTAMP '2024-01-10 06:00:00' AND submittedAt <= TIMESTAMP '2024-01-12 18:30:00'""")
def responses_in_range(spark, sf_dir):
    frame = surveys(spark, sf_dir)
    first, last = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-10 06:00:00", "2024-01-12 18:30:00"))
    return finders.in_range(frame, first, last).select("event_id", stamp("submittedAt").alias("submittedAt"))


@query("responses_by_answer", f"""
WITH {S} SELECT event_id, userId AS "userId" FROM s
WHERE surveyId = 'survey_v1' AND elk_usefulness = 'Raczej tak'""")
def responses_by_answer(spark, sf_dir):
    hits = finders.by_answer(documents_of(spark, sf_dir), "survey_v1", "elk_usefulness", "Raczej tak")
    return hits.select("event_id", "userId")


@query("survey_count", f"WITH {S} SELECT count(*) AS responses FROM s WHERE surveyId = 'survey_v0'")
def survey_count(spark, sf_dir):
    return finders.count_by_survey(surveys(spark, sf_dir), "survey_v0")


ANSWERS_JSON = "'{' || concat_ws(',', " + ", ".join(
    f"'\"{k}\":\"' || {k} || '\"'" for k in fx.HOT_ANSWERS) + ") || '}'"


@query("analytics_projection", f"""
WITH {S} SELECT {STAMP.format('submittedAt')} AS "submittedAt", {ANSWERS_JSON} AS answers FROM s""")
def analytics_projection(spark, sf_dir):
    out = finders.analytics_projection(documents_of(spark, sf_dir))
    return out.select(stamp("submittedAt").alias("submittedAt"), F.to_json("answers").alias("answers"))


# --- intake ----------------------------------------------------------------------------

@query("submission_to_answer_map", f"""
WITH {S}, {BODIES}
SELECT 'spring_js_survey_v1' AS "surveyId",
       CASE WHEN userId IS NULL THEN 'anonymous' WHEN elk_usefulness IS NULL THEN NULL ELSE userId END AS "userId",
       sessionId AS "sessionId", {STAMP.format('submittedAt')} AS "submittedAt",
       coalesce(spring_performance, '3') AS spring,
       CASE kind WHEN 2 THEN '7' WHEN 1 THEN '["' || replace(java_tech_interest, ',', '","') || '"]'
            ELSE java_tech_interest END AS technologies,
       'spring_js_hybrid' AS "surveyType", 'agent' AS browser, '/new-survey' AS referer,
       CAST(epoch_us(submittedAt) // 1000 AS VARCHAR) AS millis
FROM b""")
def submission_to_answer_map(spark, sf_dir):
    bodies = fx.request_bodies(fx.table(spark, sf_dir, "events"))
    return submissions.normalise_submissions(bodies).select(
        "surveyId", "userId", "sessionId", stamp("submittedAt").alias("submittedAt"),
        F.col("answers")["spring_performance"].alias("spring"),
        F.col("answers")["java_tech_interest"].alias("technologies"),
        "metadata.surveyType", "metadata.browser", "metadata.referer",
        F.col("metadata.technicalData")["timestamp"].alias("millis"),
    )


@query("refused_submissions", f"""
WITH {S} SELECT CASE architecture_suggestions WHEN 'Super' THEN '{{"responses":null}}' ELSE '[]' END AS body,
count(*) AS n FROM s WHERE architecture_suggestions IN ('Super', 'problem z kolejką') GROUP BY 1""")
def refused_submissions(spark, sf_dir):
    bodies = fx.request_bodies(fx.table(spark, sf_dir, "events"))
    return submissions.refused_submissions(submissions.decode_submissions(bodies)).groupBy("body").agg(F.count("*").alias("n"))


# queue lines by the last digit of the event: see fixtures.queue_lines
QUEUE = f"""{L}, z AS (SELECT event_id % 10 AS kind, * FROM l)"""


@query("intake_validation", f"""
WITH {QUEUE}
SELECT CASE kind WHEN 1 THEN 'contact' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL WHEN 4 THEN NULL
            WHEN 5 THEN 'other' ELSE 'survey' END AS type,
       CASE kind WHEN 6 THEN 'answer missing' END AS problem,
       kind <> 3 AS accepted, count(*) AS n
FROM z GROUP BY ALL""")
def intake_validation(spark, sf_dir):
    decoded = decode_messages(fx.queue_lines(fx.table(spark, sf_dir, "events")))
    return submissions.intake_problem(decoded).groupBy("type", "problem", "accepted").agg(F.count("*").alias("n"))


@query("submission_messages", f"""
WITH {S} SELECT sessionId AS "key", '{{"type":"SURVEY_SUBMITTED","surveyId":"' || surveyId || '",' ||
coalesce('"userId":"' || userId || '",', '') || '"timestamp":' || CAST(epoch_us(submittedAt) // 1000 AS VARCHAR) ||
',"data":' || {ANSWERS_JSON} || '}}' AS value FROM s""")
def messages(spark, sf_dir):
    return submission_messages(documents_of(spark, sf_dir))


# --- logs ------------------------------------------------------------------------------

@query("log_events", f"""
WITH {S} SELECT 'INFO' AS level, 'SurveyController' AS logger, 'Survey submitted: ' || surveyId AS message,
surveyId AS "surveyId", userId AS "userId", sessionId AS "sessionId",
CAST({" + ".join(f"(CASE WHEN {k} IS NULL THEN 0 ELSE 1 END)" for k in fx.HOT_ANSWERS)} AS INTEGER) AS "responseCount",
'spring-boot' AS source FROM s""")
def log_events(spark, sf_dir):
    return logs.submission_log(documents_of(spark, sf_dir)).drop("@timestamp")


LOGS = f"g AS ({fx.sql({**fx.LOG_COLUMNS, 'event_type': 'event_type'})})"
LOG_TIME = "CASE WHEN event_type IN ('error', 'signup') THEN ts + INTERVAL 1 DAY ELSE ts END"
INDEX_NAME = "CASE type WHEN 'survey' THEN 'surveys' WHEN 'spark' THEN 'spark' ELSE 'logs' END"


def routed_logs(spark, sf_dir):
    entries = fx.log_entries(fx.table(spark, sf_dir, "events"))
    return logs.index_label(logs.route_index(logs.normalise_time(entries)))


@query("log_index_route", f"""
WITH {LOGS} SELECT event_id, level, {STAMP.format(LOG_TIME)} AS logged_at,
{INDEX_NAME} || '-' || strftime({LOG_TIME}, '%Y.%m.%d') AS "index" FROM g""")
def log_index_route(spark, sf_dir):
    return routed_logs(spark, sf_dir).select("event_id", "level", stamp("@timestamp").alias("logged_at"), "index")


@query("log_index_search", f"""
WITH {LOGS}, x AS (SELECT *, {LOG_TIME} AS t FROM g)
SELECT event_id, level, message, {STAMP.format('t')} AS logged_at FROM x
WHERE {INDEX_NAME} = 'logs' AND CAST(t AS DATE) >= DATE '2024-01-20'
  AND list_has_any(regexp_split_to_array(lower(message), '[^\\p{{L}}\\p{{N}}]+'), ['v2', 'missing'])
ORDER BY t DESC, event_id DESC LIMIT 25""")
def log_index_search(spark, sf_dir):
    """Written to index folders, then searched in those of the pattern and days."""
    root = work_dir(spark, "log_index")
    write_partitioned(routed_logs(spark, sf_dir).drop("event_type", "ingested_at", "ts", "index"),
                      root, ["index_name", "index_date"])
    found = read_log_index(spark, root, "logs*", first_day="2024-01-20")
    hits = logs.search_logs(found, "v2 MISSING", 25, newest=("@timestamp", "event_id"))
    return hits.select("event_id", "level", "message", stamp("@timestamp").alias("logged_at"))


@query("log_newest_days", ORACLES["log_index_search"])
def log_newest_days(spark, sf_dir):
    """The same search from the newest day back; days behind the last hit wanted stay closed."""
    root = work_dir(spark, "log_index")
    write_partitioned(routed_logs(spark, sf_dir).drop("event_type", "ingested_at", "ts", "index"),
                      root, ["index_name", "index_date"])
    hits, _ = newest_hits(spark, root, "v2 MISSING", 25, "logs*", newest=("@timestamp", "event_id"), first_day="2024-01-20")
    return hits.select("event_id", "level", "message", stamp("@timestamp").alias("logged_at"))


@query("log_search_topk", """
SELECT conv_id, turn, text FROM conversations
WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['que', 'the', 'einach'])
ORDER BY conv_id DESC, turn DESC LIMIT 10""")
def log_search_topk(spark, sf_dir):
    talk = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return logs.search_logs(talk, "que THE einach", 10, message="text", newest=("conv_id", "turn"))


@query("text_match_count", """
SELECT lang, count(*) AS docs FROM documents
WHERE list_has_any(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), ['with', 'license'])
GROUP BY lang""")
def text_match_count(spark, sf_dir):
    from canvass.functions.text import matches_any

    docs = fx.table(spark, sf_dir, "documents").filter(matches_any(F.col("text"), "with license"))
    return docs.groupBy("lang").agg(F.count("*").alias("docs"))


@query("token_index_match_count", ORACLES["text_match_count"])
def token_index_match_count(spark, sf_dir):
    """The same documents by their postings; no text is read for the search."""
    path = work_dir(spark, "token_index")
    token_index.add_to_index(fx.table(spark, sf_dir, "documents"), path, 0, "doc_id", keep=("lang",))
    return token_index.matching(spark, path, "with license").groupBy("lang").agg(F.count("*").alias("docs"))


@query("log_display", """
SELECT conv_id, turn, CASE role WHEN 'system' THEN 'Brak wiadomości' ELSE text END AS message FROM conversations""")
def log_display(spark, sf_dir):
    talk = fx.table(spark, sf_dir, "conversations")
    shown = talk.select("conv_id", "turn", F.when(F.col("role") != "system", F.col("text")).alias("message"),
                        F.lit(None).cast("timestamp").alias("@timestamp"))
    return logs.display_defaults(shown).drop("@timestamp")


@query("log_intake_union", f"""
WITH {LOGS} SELECT level, NULL AS role, count(*) AS n FROM g GROUP BY 1
UNION ALL SELECT NULL, role, count(*) FROM conversations GROUP BY role""")
def log_intake_union(spark, sf_dir):
    entries = fx.log_entries(fx.table(spark, sf_dir, "events")).select("level", "message")
    talk = fx.table(spark, sf_dir, "conversations").select("role", F.col("text").alias("message"))
    return union_intake(entries, talk).groupBy("level", "role").agg(F.count("*").alias("n"))


# --- labels and metrics ----------------------------------------------------------------

@query("label_relabel", f"""
WITH p AS ({fx.sql(fx.POD_COLUMNS)})
SELECT event_id, container, pod, nullif(namespace, '') AS namespace, pod AS instance, container AS job,
       '/var/log/pods/*' || uid || '/' || container || '/*.log' AS path
FROM p WHERE mirror <> 'mirror' AND scrape = 'true'""")
def label_relabel(spark, sf_dir):
    kept = relabel.relabel(fx.pods(fx.table(spark, sf_dir, "events")))
    label = F.col("labels")
    return kept.select(
        "event_id", *[label[c].alias(c) for c in ("container", "pod", "namespace", "instance", "job")],
        label["__path__"].alias("path"),
    )


M = f"m AS ({fx.sql(fx.SAMPLE_COLUMNS)})"


def _rate_sql(seconds: int) -> str:
    return f"""
WITH {M},
d AS (SELECT *, epoch_us(ts) AS us, CASE WHEN value < lag(value) OVER w THEN value
             ELSE coalesce(value - lag(value) OVER w, 0) END AS step
      FROM m WINDOW w AS (PARTITION BY metric, instance ORDER BY ts)),
c AS (SELECT *, sum(step) OVER (PARTITION BY metric, instance ORDER BY ts) AS total FROM d),
r AS (SELECT *, min(total) OVER w AS low, min(us) OVER w AS since FROM c
      WINDOW w AS (PARTITION BY metric, instance ORDER BY us RANGE BETWEEN {seconds}000000 - 1 PRECEDING AND CURRENT ROW))
SELECT metric, instance, {STAMP.format('ts')} AS ts, value,
       round(CASE WHEN us > since THEN (total - low) / ((us - since) / 1000000.0) END, 6) AS rate FROM r"""


def _rates(spark, sf_dir, seconds):
    rated = samples.counter_rate(fx.samples(fx.table(spark, sf_dir, "events")), seconds)
    return rated.select("metric", F.col("labels")["instance"].alias("instance"), stamp("ts").alias("ts"),
                        "value", r6("rate").alias("rate"))


@query("counter_rate_5m", _rate_sql(300))
def counter_rate_5m(spark, sf_dir):
    return _rates(spark, sf_dir, 300)


@query("counter_rate_5h", _rate_sql(18000))
def counter_rate_5h(spark, sf_dir):
    return _rates(spark, sf_dir, 18000)


@query("cpu_busy_pct", f"""
WITH {M},
d AS (SELECT *, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS prev,
             CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS step
      FROM m WHERE metric = 'view' WINDOW w AS (PARTITION BY instance ORDER BY ts)),
t AS (SELECT d.*, g.k * 3600000000 AS eval FROM d, unnest(range((us + 3599999999) // 3600000000,
             (us + 18000000000 - 1) // 3600000000 + 1)) AS g(k)),
r AS (SELECT instance, eval, CASE WHEN max(us) > min(us) THEN
             coalesce(sum(step) FILTER (prev > eval - 18000000000), 0) / ((max(us) - min(us)) / 1000000.0) END AS rate
      FROM t GROUP BY 1, 2)
SELECT instance, strftime(make_timestamp(eval), '%Y-%m-%d %H:%M:%S.%f') AS eval_ts,
       round(100 - avg(rate) * 100, 6) AS busy_pct
FROM r WHERE rate IS NOT NULL GROUP BY 1, 2""")
def cpu_busy_pct(spark, sf_dir):
    """Of several modes and metrics only idle processor seconds count."""
    busy = samples.busy_percent(fx.cpu_samples(fx.table(spark, sf_dir, "events")), "instance", 18000, 3600)
    return busy.select("instance", stamp("eval_ts").alias("eval_ts"), r6("busy_pct").alias("busy_pct"))


@query("latest_gauge", f"""
WITH {M} SELECT metric, instance, {STAMP.format('max(ts)')} AS ts, max_by(value, ts) AS value FROM m
WHERE instance = 'u1' GROUP BY 1, 2""")
def latest_gauge(spark, sf_dir):
    hits = fx.samples(fx.table(spark, sf_dir, "events")).filter(F.col("labels")["instance"] == "u1")
    newest = samples.latest_samples(hits)
    return newest.select("metric", F.col("labels")["instance"].alias("instance"), stamp("ts").alias("ts"), "value")


@query("select_gauge", f"""
WITH {M} SELECT {STAMP.format('ts')} AS ts, value FROM m WHERE metric = 'view' AND instance = 'u0'""")
def select_gauge(spark, sf_dir):
    hits = samples.select_metric(fx.samples(fx.table(spark, sf_dir, "events")), "view", instance="u0")
    return hits.select(stamp("ts").alias("ts"), "value")
