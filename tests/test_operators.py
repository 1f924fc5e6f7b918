import datetime as dt
import json
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from canvass.operators import finders, kpi, logs, longform, popularity, ratings, relabel, reports, submissions
from canvass.sources.catalogue import FALLBACK_SURVEY, SITE_SURVEY, TECHNOLOGY_SURVEY, catalogue
from canvass.sources.logs import union_intake
from canvass.sources.queue import decode_messages
from canvass.sources.surveys import dead_letters, decode_events, landing_frame, valid_events
from tests.conftest import plan_of

T0 = dt.datetime(2024, 1, 1, 10, 0)
SURVEY = ("surveyId string, userId string, sessionId string, answers map<string,string>, submittedAt timestamp")


def survey_frame(spark, rows):
    return spark.createDataFrame(rows, SURVEY)


def answers_of(*values):
    keys = ("spring_performance", "java_tech_interest")
    return {k: v for k, v in zip(keys, values) if v is not None}


def test_reports_keep_the_different_scales(spark):
    rows = [("s", "u1", "a", answers_of("4 lub 5"), T0), ("s", None, "a", {}, T0),
            ("s", "u2", "b", answers_of("1"), T0 + dt.timedelta(days=1))]
    df = survey_frame(spark, rows)
    daily = {r["date"].isoformat(): r for r in reports.daily_stats(df).collect()}
    assert tuple(daily["2024-01-01"])[1:] == (2, 1, 1, 2.5)
    hourly = reports.hourly_report(df).collect()
    assert tuple(hourly[0]) == (10, 3, 2, pytest.approx((5 + 3 + 3) / 3))
    assert reports.daily_stats(df, exact=False).count() == 2


def test_trends_count_empty_options(spark):
    df = survey_frame(spark, [("s", "u", "a", answers_of(None, "x, y,"), T0), ("s", "u", "a", answers_of(None, ""), T0)])
    votes = {r["technology_clean"]: r["daily_votes"] for r in reports.tech_trends(df).collect()}
    assert votes == {"x": 1, "y": 1, "": 2}


def test_summary_of_nothing(spark):
    df = survey_frame(spark, [])
    summary = reports.run_summary(reports.daily_stats(df), reports.hourly_report(df), reports.answer_correlations(df))
    assert tuple(summary.first()) == (0, 0, None)


def test_single_rating_has_no_deviation(spark):
    df = survey_frame(spark, [("s", "u", "a", answers_of("4"), T0)])
    row = ratings.rating_windows(df).first()
    assert row["rating_stddev"] is None and row["avg_rating"] == 4.0
    assert row["rating_counts"] == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 0}


@pytest.mark.parametrize("page_size", [1, 3, 7, 100])
def test_rating_pages_hold_every_value(spark, page_size):
    texts = ["1", "brak", "5", "3", "3", "4 lub 5", "2"] * 3
    df = survey_frame(spark, [("s", "u", "a", answers_of(t), T0) for t in texts])
    pages = ratings.rating_values(ratings.rating_windows(df), page_size).orderBy("page").collect()
    assert [p["page"] for p in pages] == list(range(len(pages)))
    assert all(len(p["all_ratings"]) == page_size for p in pages[:-1])
    assert [r for p in pages for r in p["all_ratings"]] == sorted([1, 0, 5, 3, 3, 4, 2] * 3)


def test_distribution_has_all_bars(spark):
    df = survey_frame(spark, [("s", "u", "a", answers_of("4"), T0), ("s", "u", "a", answers_of("x"), T0)])
    assert [tuple(r) for r in ratings.rating_distribution(df).collect()] == [
        ("1", 0), ("2", 0), ("3", 0), ("4", 1), ("5", 0)]


def test_partial_popularity_merges_to_the_whole(spark):
    rows = [("s", "u", "a", answers_of(None, t), T0 + dt.timedelta(seconds=i % 3))
            for i, t in enumerate(["x,y", "x", "y, x", "", "z,"])]
    df = survey_frame(spark, rows)
    halves = popularity.partial_popularity(survey_frame(spark, rows[:2])).unionAll(
        popularity.partial_popularity(survey_frame(spark, rows[2:])))
    whole = popularity.tech_popularity(df)
    assert sorted(map(tuple, popularity.merge_popularity(halves).collect())) == sorted(map(tuple, whole.collect()))


def test_key_figures_of_nothing(spark):
    row = kpi.overview(survey_frame(spark, [])).first()
    assert (row["totalResponses"], row["avgRating"], row["uniqueUsers"], row["page"]) == (0, 0.0, 0, 0)
    assert row["techPopularity"] == {} and row["ratingsChart"]["data"] == [0] * 5


def test_overview_pages_hold_every_technology(spark):
    df = survey_frame(spark, [("s", "u", "a", answers_of("5", f"t{i},t{i % 3}"), T0) for i in range(20)])
    pages = kpi.overview(df, page_size=4).orderBy("page").collect()
    assert len(pages) > 1 and [p["totalResponses"] for p in pages] == [20] + [None] * (len(pages) - 1)
    votes = {k: v for p in pages for k, v in p["techPopularity"].items()}
    assert votes == dict(Counter(t for i in range(20) for t in (f"t{i}", f"t{i % 3}")))


def test_key_figures_count_a_missing_session_once(spark):
    rows = [("s", "u", None, answers_of("5"), T0), ("s", "u", None, answers_of("2 i 4"), T0),
            ("s", "u", "a", {"spring_performance": None}, T0), ("s", "u", "b", {}, T0)]
    row = kpi.key_figures(survey_frame(spark, rows)).first()
    # a key with a null value rates as 0, an absent key does not count
    assert tuple(row)[:3] == (4, 2.3, 3)


def test_votes_from_lists_and_texts(spark):
    bodies = [
        {"responses": [{"questionId": "java_tech_interest", "answer": ["Spring Boot", " Quarkus\t"]}]},
        {"responses": [{"questionId": "java_tech_interest", "answer": "Quarkus, Hibernate,,"}]},
        {"responses": [{"questionId": "java_tech_interest", "answer": 7}]},
        {"responses": [{"questionId": "java_tech_interest", "answer": ""}]},
        {"responses": [{"questionId": "java_tech_interest", "answer": {"a": 1}}]},
        {"responses": [{"questionId": "other", "answer": "x"}]},
    ]
    typed = kpi.list_aware_votes(submissions.normalise_submissions(raw_bodies(spark, bodies)))
    expected = {"Spring Boot": 1, "Quarkus": 2, "Hibernate": 1, "": 1}
    assert {r["technology"]: r["votes"] for r in typed.collect()} == expected
    # without JSON types a list is known by its text
    rows = [("s", "u", "a", answers_of(None, t), T0) for t in ('["Spring Boot"," Quarkus "]', "[oops", "a,")]
    plain = kpi.list_aware_votes(survey_frame(spark, rows))
    assert {r["technology"]: r["votes"] for r in plain.collect()} == {"Spring Boot": 1, "Quarkus": 1, "[oops": 1, "a": 1}


def test_numeric_rating_scores_zero(spark):
    bodies = [{"responses": [{"questionId": "spring_performance", "answer": 5}]},
              {"responses": [{"questionId": "spring_performance", "answer": "5"}]}]
    row = kpi.key_figures(submissions.normalise_submissions(raw_bodies(spark, bodies))).first()
    assert row["avgRating"] == 2.5


def raw_bodies(spark, bodies):
    rows = [(b if isinstance(b, str) else json.dumps(b, ensure_ascii=False), f"s{i}", "agent", None, "::1", T0)
            for i, b in enumerate(bodies)]
    return spark.createDataFrame(
        rows, "body string, sessionId string, userAgent string, referer string, ipAddress string, receivedAt timestamp")


def test_submissions(spark):
    bodies = [
        {"userId": "x", "responses": [{"questionId": "a", "answer": "1"}, {"questionId": "b", "answer": [1, "z"]},
                                      {"questionId": "a", "answer": "2"}, {"answer": "lost"}]},
        {"responses": []},
        {"userId": None, "responses": [{"questionId": "a", "answer": None}]},
        {"userId": "x"}, {"responses": None}, "oops", "[]", '{"responses":[]} x',
    ]
    raw = raw_bodies(spark, bodies)
    rows = {r["sessionId"]: r for r in submissions.normalise_submissions(raw).collect()}
    assert set(rows) == {"s0", "s1", "s2"}
    assert rows["s0"]["answers"] == {"a": "2", "b": '[1,"z"]'} and rows["s0"]["userId"] == "x"
    assert rows["s1"]["answers"] == {} and rows["s1"]["userId"] == "anonymous"
    assert rows["s2"]["answers"] == {"a": None} and rows["s2"]["userId"] is None
    assert rows["s0"]["metadata"]["technicalData"]["springVersion"] == "3.1.0"
    assert submissions.refused_submissions(submissions.decode_submissions(raw)).count() == 5


def test_answers_to_rows_and_back(spark):
    given = {"spring_performance": "5", "7": "free"}
    df = survey_frame(spark, [("s", "u", "a", given, T0)])
    rows = {r["questionId"]: r for r in submissions.answer_rows(df, catalogue(spark)).collect()}
    assert rows["7"]["question"] == "" and rows["spring_performance"]["question"].startswith("Jak oceniasz")
    assert rows["7"]["timestamp"] == "2024-01-01T10:00:00.000Z"
    assert {k: r["answer"] for k, r in rows.items()} == given


def test_catalogues(spark):
    for questions in (TECHNOLOGY_SURVEY, SITE_SURVEY, FALLBACK_SURVEY):
        assert catalogue(spark, questions).count() == 5
    # ids that repeat take the first question
    doubled = catalogue(spark).unionAll(catalogue(spark).withColumns(
        {"position": F.col("position") + 9, "text": F.lit("later")}))
    df = spark.createDataFrame([("elk_usefulness", "x")], "questionId string, answer string")
    assert longform.answers_with_question(df, doubled).first()["question"].startswith("Czy")


@pytest.mark.parametrize("page_size", [1, 4, 1000])
def test_nested_pages_hold_every_answer(spark, page_size):
    rows = [("hot", f"a{i}", i % 7) for i in range(50)] + [(None, "x", 1), ("cold", None, 2)]
    counts = spark.createDataFrame(rows, "question string, answer string, count long")
    pages = longform.answers_nested(counts, page_size).collect()
    back = [(p["question"], a["answer"], a["count"]) for p in pages for a in p["answers"]]
    assert Counter(back) == Counter(rows)
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[2], r[1]))
    for p in pages:
        here = [(p["question"], a["answer"], a["count"]) for a in p["answers"]]
        if p["question"] == "hot":  # pages of the whole order
            assert here == hot[p["page"] * page_size:(p["page"] + 1) * page_size]
        assert [a["count"] for a in p["answers"]] == sorted((a["count"] for a in p["answers"]), reverse=True)
    if page_size == 1000:
        assert len(pages) == 3 and all(p["page"] == 0 for p in pages)


def test_blank_answers_are_left_out(spark):
    blanks = "\u00a0\u1680\u2003\u2028\u202f\u205f\u3000\ufeff\t\x0b"
    df = spark.createDataFrame([("q", f"{blanks}a\n"), ("q", blanks), ("q", "  "), ("q", None)], "question string, answer string")
    assert [tuple(r) for r in longform.clean_answers(df).collect()] == [("q", "a")]


def test_finders(spark, tmp_path):
    rows = [("s1", "u", "a", answers_of("5"), T0 + dt.timedelta(days=d)) for d in range(5)] + [("s2", "u", "b", {}, T0)]
    df = survey_frame(spark, rows)
    path = str(tmp_path / "t")
    landing_frame(df).write.partitionBy("submitted_date").parquet(path)
    landed = spark.read.parquet(path)
    hits = finders.in_range(landed, T0, T0 + dt.timedelta(days=1))
    assert hits.count() == 3
    assert "PartitionFilters: [isnotnull(submitted_date" in plan_of(hits)
    assert finders.by_answer(landed, "s1", "spring_performance", "5").count() == 5
    assert "PushedFilters: [IsNotNull(surveyId), IsNotNull(spring_performance)" in plan_of(
        finders.by_answer(landed, "s1", "spring_performance", "5"))
    assert finders.count_by_survey(df, "s2").first()[0] == 1
    assert finders.analytics_projection(df).columns == ["answers", "submittedAt"]


def test_events_in_both_layouts(spark):
    lines = [
        '{"surveyId":"s","sessionId":"x","answers":{"a":"1"},"submittedAt":"2024-01-01T10:00:00Z"}',
        '{"type":"SURVEY_SUBMITTED","surveyId":"s","userId":"u","timestamp":1704103200000,"data":{"a":["p","q"],"b":5}}',
        "oops", "[1]", "{}", '{"surveyId":"s","answers":{"a":"1"}}',
    ]
    decoded = decode_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    good = valid_events(decoded).collect()
    assert [r["submittedAt"] for r in good] == [T0, T0]
    assert good[1]["answers"] == {"a": '["p","q"]', "b": "5"}
    assert [r["value"] for r in dead_letters(decoded).collect()] == lines[2:]


def test_queue_messages(spark):
    lines = ["oops", "[1]", "{}", '{"type":"other"}', '{"type":"survey","question":"q","answer":5,"timestamp":1.5}',
             '{"type":"survey","question":"q","answer":["x"]}', '{"type":"contact","email":"e","message":"m"}',
             json.dumps({"type": "contact", "email": "e" * 256, "message": "m"}), "null", '{"type":5}']
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = {r["value"]: r for r in submissions.intake_problem(decode_messages(frame)).collect()}
    assert rows["oops"]["type"] == "unknown" and json.loads(rows["oops"]["payload"]) == {"raw": "oops", "type": "unknown"}
    assert [rows[x]["accepted"] for x in ("oops", "[1]", "{}", "null")] == [True, False, True, False]
    assert rows[lines[4]]["answer"] == "5" and rows[lines[4]]["queued_at"] == dt.datetime(1970, 1, 1, 0, 0, 1, 500000)
    assert rows[lines[5]]["problem"] == "answer missing"
    assert rows[lines[6]]["problem"] is None and rows[lines[7]]["problem"] == "email too long"
    assert rows['{"type":5}']["type"] is None


def test_log_times_and_indices(spark):
    rows = [("survey", "2024-01-31T23:30:00Z"), ("spark", "2024-02-01T00:30:00+01:00"), ("x", "n/a"), (None, None)]
    df = spark.createDataFrame([(*r, T0) for r in rows], "type string, timestamp string, ingested_at timestamp")
    out = logs.index_label(logs.route_index(logs.normalise_time(df)))
    assert "timestamp" not in out.columns
    assert [r["index"] for r in out.collect()] == [
        "surveys-2024.01.31", "spark-2024.01.31", "logs-2024.01.01", "logs-2024.01.01"]


def test_log_search_is_top_k(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i % 5), f"word{i % 3} text") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, `@timestamp` timestamp, message string")
    hits = logs.search_logs(df, "WORD1 nothing", 4, newest=("@timestamp", "id"))
    want = sorted((r for r in rows if r[0] % 3 == 1), key=lambda r: (r[1], r[0]), reverse=True)[:4]
    assert [h["id"] for h in hits.collect()] == [w[0] for w in want]
    assert "TakeOrderedAndProject" in plan_of(hits)
    assert logs.search_logs(df, "", 7).count() == 7


def test_log_defaults_and_union(spark):
    a = spark.createDataFrame([("", T0)], "message string, `@timestamp` timestamp")
    b = spark.createDataFrame([("INFO",)], "level string")
    shown = logs.display_defaults(union_intake(a, b)).collect()
    assert {r["message"] for r in shown} == {"Brak wiadomości"}
    assert all(r["@timestamp"] for r in shown)


def test_relabel_rules(spark):
    rows = [({"a": "x1", "b": "2", "k": "yes"},), ({"a": "y", "k": "yes", "t": "old"},), ({"k": "yes!"},), ({"a": "mirror", "k": "yes"},)]
    df = spark.createDataFrame(rows, "labels map<string,string>")
    rules = (
        relabel.Rule("keep", ("k",), "yes"),
        relabel.Rule("drop", ("a",), "mirror"),
        relabel.Rule("replace", ("a", "b"), r"x(\d);(.*)", "t", "${1}-$2"),
        relabel.Rule("replace", ("t",), target_label="copy"),
        relabel.Rule("replace", ("missing",), target_label="k"),
    )
    out = [r["labels"] for r in relabel.relabel(df, rules).collect()]
    assert out == [{"a": "x1", "b": "2", "t": "1-2", "copy": "1-2"}, {"a": "y", "t": "old", "copy": "old"}]
    with pytest.raises(ValueError):
        relabel.relabel(df, (relabel.Rule("hashmod"),))


def test_grouped_answers_count(spark):
    rows = [("q", "a")] * 3 + [("q", "b")] + [("p", "a")]
    counts = longform.answer_counts(spark.createDataFrame(rows, "question string, answer string"))
    assert [tuple(r) for r in longform.counts_in_order(counts).collect()] == [("p", "a", 1), ("q", "a", 3), ("q", "b", 1)]
    assert longform.distinct_answer_pairs(counts).first()[0] == 3
    labels = {r["label"]: r["data"] for r in longform.chart_labels(counts).collect()}
    assert labels["q: a"] == 3 and isinstance(defaultdict(int, labels), dict)


def test_intake_refuses_numbers_where_texts_are_asked_for(spark):
    lines = spark.createDataFrame([('{"type":"survey","question":"q","answer":5}',), ('{"type":"survey","question":"q","answer":"5"}',),
                                   ('{"type":"contact","email":1,"message":"m"}',)], "value string")
    decoded = decode_messages(lines)
    assert {r["problem"] for r in submissions.intake_problem(decoded).collect()} == {None}
    strict = [r["problem"] for r in submissions.intake_problem(decoded, texts_only=True).collect()]
    assert sorted(strict, key=str) == [None, "answer missing", "email missing"]


def test_result_tables_are_read_in_order(spark):
    rows = [(f"s{i % 3}", f"u{i}", f"x{i}", answers_of(str(i % 5 + 1)), T0 + dt.timedelta(days=i % 4, hours=i % 5)) for i in range(40)]
    df = survey_frame(spark, rows).withColumn("answers", F.map_concat(
        F.map_filter("answers", lambda k, _: k != "java_tech_interest"), F.create_map(F.lit("java_tech_interest"), F.lit("a, b,a"))))

    def read(report, *names):
        return [tuple(r[n] for n in names) for r in reports.newest_first(report).collect()]

    days = [r[0] for r in read(reports.daily_stats(df), "date")]
    assert days == sorted(days, reverse=True) and len(days) == 4
    hours = [r[0] for r in read(reports.hourly_report(df), "hour")]
    assert hours == sorted(hours) and len(hours) == 5
    trends = read(reports.tech_trends(df), "date", "daily_votes", "technology_clean")
    assert trends == sorted(trends, key=lambda r: (-r[0].toordinal(), -r[1], r[2])) and len(trends) == 8
    votes = read(popularity.tech_popularity(df), "total_votes", "technology_clean")
    assert votes == [(80, "a"), (40, "b")]
