"""Streams against batch results, in several files, with late rows, and after a restart."""

import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from canvass import schemas
from canvass.operators import popularity, ratings, text_features
from canvass.operators.reports import newest_first
from canvass.plans import batch_report
from canvass.plans.batch_report import land_surveys, run_batch_report
from canvass.sinks import connectors, ledger, tables
from canvass.sinks.messages import submission_messages
from canvass.sources.surveys import decode_events, read_event_files, read_surveys, valid_events
from canvass.sources.tables import jdbc_options
from canvass.streaming import intake, queries

T0 = dt.datetime(2024, 1, 1, 10, 0)


def event(i, minutes, spring="4", tech="x, y", text="super"):
    answers = {"spring_performance": spring, "java_tech_interest": tech, "architecture_suggestions": text}
    return json.dumps({
        "surveyId": "s", "sessionId": f"x{i}", "answers": {k: v for k, v in answers.items() if v is not None},
        "submittedAt": (T0 + dt.timedelta(minutes=minutes)).isoformat() + "Z",
    })


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f".{name}.tmp"), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    # streams take files in the order of their times
    number = int(name.split(".")[0])
    os.utime(os.path.join(folder, f".{name}.tmp"), (1_700_000_000 + number, 1_700_000_000 + number))
    os.rename(os.path.join(folder, f".{name}.tmp"), os.path.join(folder, name))


def stream(spark, folder):
    return valid_events(decode_events(read_event_files(spark, folder, files_per_trigger=1)))


def batch(spark, folder):
    return valid_events(decode_events(spark.read.text(folder)))


def rows(df):
    return sorted((repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def dirs(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoints")


def fill(folder):
    put(folder, "1.txt", [event(i, i) for i in range(0, 8)])
    put(folder, "2.txt", [event(i, i - 5, spring="2 lub 3") for i in range(8, 16)])
    put(folder, "3.txt", [event(i, i, spring=None, tech="y,", text=None) for i in range(16, 30)] + ["broken"])


def test_stateless_streams_equal_batch(spark, dirs):
    folder, out, checkpoints = dirs
    fill(folder)
    queries.start_text(stream(spark, folder), out, checkpoints).awaitTermination()
    queries.start_audit(stream(spark, folder), out, checkpoints).awaitTermination()
    queries.start_popularity_partials(stream(spark, folder), out, checkpoints).awaitTermination()
    stored = tables.read_batches(spark, f"{out}/text_analysis")
    # the third batch has no suggestions
    assert {r["batch_id"] for r in stored.collect()} == {0, 1}
    assert rows(stored.drop("batch_id")) == rows(text_features.text_analysis(batch(spark, folder)))
    audit = spark.read.parquet(f"{out}/spark_surveys")
    assert audit.count() == 30 and audit.filter("answers_json IS NULL OR `@timestamp` IS NULL").count() == 0
    merged = popularity.merge_popularity(tables.read_batches(spark, f"{out}/tech_partials"))
    assert rows(merged) == rows(popularity.tech_popularity(batch(spark, folder)))


def test_updated_windows_keep_the_latest_state(spark, dirs):
    folder, out, checkpoints = dirs
    fill(folder)
    queries.start_ratings(stream(spark, folder), out, checkpoints, watermark=None).awaitTermination()
    stored = tables.read_batches(spark, f"{out}/rating_analysis")
    whole = ratings.rating_windows(batch(spark, folder))
    assert stored.count() > whole.count()
    assert rows(tables.latest_per_key(stored, ["window"])) == rows(whole)


def data_folders(path):
    return len(os.listdir(f"{path}/data"))


def test_many_batches_lie_in_few_parts(spark, tmp_path):
    path, by_day = str(tmp_path / "t"), str(tmp_path / "d")
    for batch_id in range(50):
        changed = spark.createDataFrame([(batch_id % 3, batch_id), (100 + batch_id, 0)], "k long, v long")
        tables.write_batch(changed, path, batch_id, fold=lambda df: tables.latest_rows(df, ["k"]))
        if batch_id < 20:
            tables.write_batch(changed.withColumn("day", F.col("k") % 2), by_day, batch_id, ["day"])
    # three sizes of parts, fewer than eight of each, and the newest batch
    assert data_folders(path) <= 3 * 7 + 1 and data_folders(by_day) <= 2 * 7 + 1
    newest = {r["k"]: r["v"] for r in tables.latest_per_key(tables.read_batches(spark, path), ["k"]).collect()}
    assert newest == {0: 48, 1: 49, 2: 47, **{100 + i: 0 for i in range(50)}}
    assert tables.read_batches(spark, path).count() < 100
    days = tables.read_batches(spark, by_day)
    assert days.count() == 40 and days.filter("day = 1").count() == sum(b % 3 == 1 for b in range(20)) + 10
    with pytest.raises(ValueError, match="folded already"):
        tables.write_batch(changed, path, 3)


def test_a_folder_has_one_writer(spark, dirs):
    folder, out, checkpoints = dirs
    fill(folder)
    tables.write_batch(spark.range(1), f"{out}/spark_surveys", 0)
    with pytest.raises(ValueError, match="holds batches"):
        queries.start_audit(stream(spark, folder), out, checkpoints)
    with pytest.raises(ValueError, match="holds batches, not snapshot"):
        tables.write_snapshot(spark.range(1), f"{out}/spark_surveys", 0)
    tables.append(spark.range(1), f"{out}/other")
    with pytest.raises(ValueError, match="something else"):
        tables.write_batch(spark.range(1), f"{out}/other", 0)


def test_complete_mode_replaces_the_table(spark, dirs):
    folder, out, checkpoints = dirs
    fill(folder)
    queries.start_popularity(stream(spark, folder), out, checkpoints).awaitTermination()
    table = tables.read_snapshot(spark, f"{out}/tech_popularity")
    expected = popularity.tech_popularity(batch(spark, folder))
    assert rows(table.drop("unique_sessions")) == rows(expected.drop("unique_sessions"))
    assert data_folders(f"{out}/tech_popularity") == 2
    ordered = [r["total_votes"] for r in newest_first(table).collect()]
    assert ordered == sorted(ordered, reverse=True)


def test_late_rows_are_dropped_and_counted(spark, dirs):
    folder, out, checkpoints = dirs
    put(folder, "1.txt", [event(1, 0), event(2, 1)])
    put(folder, "2.txt", [event(3, 60)])
    put(folder, "3.txt", [event(4, 61)])
    # the watermark of a batch applies to the rows of the one after it
    put(folder, "4.txt", [event(5, 2)])
    put(folder, "5.txt", [event(6, 90)])
    late = queries.LateRows()
    spark.streams.addListener(late)
    query = queries.start_final_ratings(stream(spark, folder), out, checkpoints)
    query.awaitTermination()
    for _ in range(100):  # events come a little later
        if str(query.id) in late.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(late)
    final = tables.read_batches(spark, f"{out}/rating_final")
    got = {r["window"]["start"]: r["total_responses"] for r in final.collect()}
    assert got == {T0: 2, T0 + dt.timedelta(minutes=60): 2}
    assert late.count(query) == 1


def test_restart_adds_only_new_rows(spark, dirs):
    folder, out, checkpoints = dirs
    put(folder, "1.txt", [event(i, i) for i in range(4)])
    queries.start_text(stream(spark, folder), out, checkpoints).awaitTermination()
    queries.start_text(stream(spark, folder), out, checkpoints).awaitTermination()
    assert tables.read_batches(spark, f"{out}/text_analysis").count() == 4
    put(folder, "2.txt", [event(9, 9)])
    queries.start_text(stream(spark, folder), out, checkpoints).awaitTermination()
    stored = tables.read_batches(spark, f"{out}/text_analysis")
    assert stored.count() == 5 and {r["batch_id"] for r in stored.collect()} == {0, 1}


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_batch(spark.range(5), path, 7)
    tables.write_batch(spark.range(5), path, 7)
    tables.write_batch(spark.range(2), path, 8)
    assert tables.read_batches(spark, path).count() == 7
    # also after a new checkpoint began at 0, and for an empty result
    for batch_id, size in ((0, 3), (1, 4), (2, 5), (2, 6), (7, 3), (0, 5), (1, 0)):
        tables.write_snapshot(spark.range(size), path + "s", batch_id)
        assert tables.read_snapshot(spark, path + "s").count() == size


def test_overwriting_ignores_the_session_mode(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for k in (1, 2):
            tables.write_batch(spark.range(1).withColumn("day", F.lit(k)), path, 0, ["day"])
            tables.write_partitioned(spark.range(1).withColumn("day", F.lit(k)), path + "o", ["day"], "overwrite")
            tables.write_partitioned(spark.range(1).withColumn("day", F.lit(k)), path + "r", ["day"], "replace")
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert tables.read_batches(spark, path).count() == 1
    assert spark.read.parquet(path + "o").count() == 1 and spark.read.parquet(path + "r").count() == 2


def test_four_queries_side_by_side(spark, dirs):
    folder, out, checkpoints = dirs
    fill(folder)
    running = queries.start_all(stream(spark, folder), out, checkpoints, once=True)
    # only the landing reads the source
    assert [q.name for q in running][0] == "landed_surveys" and len(running) == 5
    for query in running:
        query.awaitTermination()
    assert sorted(os.listdir(checkpoints)) == sorted(queries.TRIGGERS)
    # with triggers they go on until one is stopped
    running = queries.start_all(stream(spark, folder), out, checkpoints)
    assert all(q.isActive for q in running)
    running[0].stop()
    queries.await_any(spark, running)
    assert not any(q.isActive for q in running)
    spark.streams.resetTerminated()


def test_event_intake(spark, dirs):
    folder, out, checkpoints = dirs
    fill(folder)
    intake.start_event_intake(read_event_files(spark, folder), out, checkpoints).awaitTermination()
    landed = tables.read_batches(spark, f"{out}/survey_responses")
    assert landed.count() == 30 and set(schemas.HOT_ANSWERS) < set(landed.columns)
    assert [r["value"] for r in tables.read_batches(spark, f"{out}/dead_letters").collect()] == ["broken"]


def test_streams_go_on_from_the_landed_table(spark, dirs):
    folder, out, checkpoints = dirs
    fill(folder)
    queries.start_landing(stream(spark, folder), out, checkpoints).awaitTermination()
    landed = spark.read.parquet(f"{out}/landed_surveys")
    assert landed.count() == 30 and "submitted_date" in landed.columns
    again = spark.readStream.schema(landed.schema).parquet(f"{out}/landed_surveys")
    queries.start_ratings(again, out, checkpoints, watermark=None).awaitTermination()
    got = tables.latest_per_key(tables.read_batches(spark, f"{out}/rating_analysis"), ["window"])
    assert rows(got) == rows(ratings.rating_windows(batch(spark, folder)))


def test_router_publishes_what_it_forwards(spark, dirs):
    folder, out, checkpoints = dirs
    put(folder, "1.txt", ['{"type":"survey","question":"q","answer":"a"}', "oops", "[1]", '{"type":"other"}'])
    sent = []
    intake.start_router(
        read_event_files(spark, folder), out, checkpoints,
        publish=lambda df, batch_id: sent.extend(r["value"] for r in df.collect()),
    ).awaitTermination()
    assert sorted(sent) == sorted(['{"type":"survey","question":"q","answer":"a"}',
                                   '{"raw":"oops","type":"unknown"}', '{"type":"other"}'])
    assert tables.read_batches(spark, f"{out}/survey_responses").count() == 1
    assert tables.read_batches(spark, f"{out}/contact_messages").count() == 0
    assert not os.path.exists(f"{out}/forwarded")


def test_routed_and_audited_rows_reach_other_stores(spark, dirs):
    folder, out, checkpoints = dirs
    put(folder, "1.txt", ['{"type":"survey","question":"q","answer":"a"}', "oops"])
    copied = {}

    def copy(df, name):
        copied[name] = copied.get(name, 0) + df.count()

    write = queries.copying(tables.write_batch, copy)
    intake.start_router(read_event_files(spark, folder), out, checkpoints, write=write).awaitTermination()
    assert copied == {"survey_responses": 1, "contact_messages": 0, "forwarded": 2, "dead_letters": 0}
    copied.clear()
    events = str(folder) + "2"
    fill(events)
    queries.start_audit(stream(spark, events), out, checkpoints, write=write).awaitTermination()
    assert copied == {"spark_surveys": 30}
    copied.clear()
    put(str(folder) + "3", "1.json", [json.dumps({"body": '{"responses":[{"questionId":"x","answer":5}]}', "sessionId": "s"})])
    bodies = spark.readStream.schema("body string, sessionId string, userAgent string, referer string, "
                                     "ipAddress string, receivedAt timestamp").json(str(folder) + "3")
    intake.start_submissions(bodies, out + "2", checkpoints, write=write).awaitTermination()
    assert copied == {"survey_responses": 1, "survey_events": 1, "logs": 1, "refused": 0}


def test_an_interval_trigger_runs(spark, dirs):
    folder, out, checkpoints = dirs
    fill(folder)
    query = queries.start_text(stream(spark, folder), out, checkpoints, interval="1 second")
    query.processAllAvailable()
    query.stop()
    assert tables.read_batches(spark, f"{out}/text_analysis").count() == 16


def test_stored_rows_are_copied(spark, dirs):
    folder, out, checkpoints = dirs
    fill(folder)
    copies = []

    def copy(df, name):
        copies.append((name, df.count(), "batch_id" in df.columns))

    write = queries.copying(tables.write_batch, copy)
    queries.start_text(stream(spark, folder), out, checkpoints, write=write).awaitTermination()
    assert copies == [("text_analysis", 8, True), ("text_analysis", 8, True), ("text_analysis", 0, True)]
    assert tables.read_batches(spark, f"{out}/text_analysis").count() == 16


def test_batch_report_is_stored_and_copied(spark, dirs):
    folder, out, _ = dirs
    fill(folder)
    copies = {}
    source = batch(spark, folder).drop("metadata")
    run_batch_report(source, out, f"{out}/landed", copy=lambda df, name: copies.update({name: df.count()}))
    assert copies == {"daily_stats": 1, "tech_trends": 3, "correlations": 1, "hourly_report": 1, "survey_reports": 1}
    run_batch_report(source, out, exact=False)
    assert spark.read.parquet(f"{out}/survey_reports").count() == 2
    assert batch_report.read_reports(spark, out)["daily_stats"].count() == 1


def test_batch_report_passes_over_the_submissions_three_times(spark, dirs, monkeypatch):
    folder, out, _ = dirs
    fill(folder)
    landed = land_surveys(batch(spark, folder).drop("metadata"), f"{out}/landed")
    scans = []

    plain = tables.overwrite

    def write(df, path):
        if any("/landed/" in f for f in df.inputFiles()):
            scans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        plain(df, path)

    monkeypatch.setattr(tables, "overwrite", write)
    batch_report.write_reports(landed, out)
    assert scans == [1, 1, 1]


def test_landing_replaces_days(spark, tmp_path):
    path = str(tmp_path / "landed")

    def day_of(day, *ids):
        return spark.createDataFrame([("s", "u", i, {"a": i}, dt.datetime(2024, 1, day)) for i in ids],
                                     "surveyId string, userId string, sessionId string, answers map<string,string>, submittedAt timestamp")

    land_surveys(day_of(1, "x", "y").unionAll(day_of(2, "z")), path)
    landed = land_surveys(day_of(2, "v", "w"), path)
    assert {r["answers"]["a"] for r in landed.collect()} == {"x", "y", "v", "w"}


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_stored_submissions_are_read_and_reported(spark, tmp_path, fmt):
    row = ("s", "u", "x", {"spring_performance": "5", "integration_quality": "4"}, T0,
           ("web", "b", "i", "a", "r", {"k": "v"}))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([row, row], schemas.STORED_SURVEY).write.format(fmt).save(path)
    run_batch_report(read_surveys(spark, path, fmt), out)
    assert batch_report.read_reports(spark, out)["daily_stats"].first()["avg_rating"] == 5.0
    # one rating only: no correlation, and NULL stays NULL in the ledger
    run = ledger.current_states(spark.read.parquet(f"{out}/spark_analytics")).first()
    assert run["status"] == "COMPLETED" and run["results"]["avg_correlation"] is None


@pytest.mark.parametrize("writer", [
    connectors.to_collections("mongodb://h", "db"), connectors.to_indices("h"),
    connectors.to_tables("jdbc:postgresql://h/db"),
])
def test_stores_need_their_packages(spark, writer):
    with pytest.raises(Exception, match="(?i)DATA_SOURCE_NOT_FOUND|No suitable driver|Failed to find"):
        writer(spark.range(1), "t")


def test_message_keys_spread(spark):
    df = spark.createDataFrame([("s", "u", f"x{i}", {"a": "1"}, T0) for i in range(3)],
                               "surveyId string, userId string, sessionId string, answers map<string,string>, submittedAt timestamp")
    sent = submission_messages(df)
    assert {r["key"] for r in sent.collect()} == {"x0", "x1", "x2"}
    back = valid_events(decode_events(sent.select("value")))
    assert {(r["surveyId"], r["submittedAt"], r["answers"]["a"]) for r in back.collect()} == {("s", T0, "1")}


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "runs")
    ledger.recorded(spark, path, "trend", lambda: {"results": {"n": 1}, "metrics": {"m": 2}}, {"p": True})
    with pytest.raises(ZeroDivisionError):
        ledger.recorded(spark, path, "trend", lambda: 1 / 0)
    runs = ledger.latest_runs(spark.read.parquet(path), "trend").collect()
    assert [r["status"] for r in runs] == ["FAILED", "COMPLETED"]
    assert runs[0]["results"] == {"error": "ZeroDivisionError"}
    assert spark.read.parquet(path).filter("status = 'PROCESSING'").count() == 2
    assert runs[1]["metrics"]["m"] == 2.0 and runs[1]["sparkApplicationId"] == spark.sparkContext.applicationId
    with pytest.raises(ValueError):
        ledger.run_entry(spark, "trend", "DONE")


def test_jdbc_reads_are_split():
    options = jdbc_options("jdbc:postgresql://h/db", "survey_responses", "id", 1, 100, 8)
    assert options["numPartitions"] == "8" and options["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        jdbc_options("u", "t", "id", 5, 1, 8)


def test_distinct_counts_are_refused_on_streams(spark, dirs):
    folder, out, checkpoints = dirs
    fill(folder)
    table = popularity.tech_popularity(stream(spark, folder))
    with pytest.raises(Exception, match="(?i)distinct aggregations are not supported"):
        table.writeStream.outputMode("complete").format("noop").option("checkpointLocation", checkpoints).start()


def test_hidden_files_are_not_read(spark, dirs):
    folder, _, _ = dirs
    put(folder, "1.txt", [event(1, 1)])
    assert batch(spark, folder).filter(F.col("surveyId") == "s").count() == 1
