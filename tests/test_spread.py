"""Work on events is spread over more tasks as the table grows."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from canvass.operators import submissions
from canvass.sinks.tables import read_batches
from canvass.streaming import intake, rates
from workload import batch_queries, fixtures as fx


def events_of(spark, folder, rows):
    """A table in one file of one row group."""
    table = spark.range(rows).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"),
        (F.col("id") % 10).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    table.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_micro_batches_get_more_files(spark, tmp_path):
    rows = 2 * fx.FILES * fx.PARTS * fx.FILE_ROWS
    stream = fx.event_table_stream(spark, events_of(spark, tmp_path / "t", rows))
    query = stream.writeStream.foreachBatch(lambda batch, k: batch.write.parquet(f"{tmp_path}/out/{k}")) \
        .option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    sources = sorted((tmp_path / "c" / "sources" / "0").glob("[0-9]*"))
    files = [[json.loads(line)["path"] for line in Path(s).read_text().splitlines()[1:]] for s in sources]
    assert [len(f) for f in files] == [2 * fx.PARTS] * fx.FILES
    counts = [spark.read.parquet(f"{tmp_path}/out/{k}").count() for k in range(fx.FILES)]
    assert sum(counts) == rows and max(counts) < rows / 2


def test_rows_of_one_group_are_dealt_over_tasks(spark, tmp_path):
    folder = events_of(spark, tmp_path, 3 * fx.FILE_ROWS)
    dealt = fx.spread_events(spark, folder)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 3 and sum(sizes) == 3 * fx.FILE_ROWS and max(sizes) < 1.5 * fx.FILE_ROWS


def test_refreshing_gathers_no_times(spark, monkeypatch):
    """The time that parts the landings comes from a sketch, computed once."""
    monkeypatch.setattr(batch_queries.F, "median", None)
    found = batch_queries._in_two_runs(spark, "/root/testdata/sf0.001", True)["daily_stats"]
    assert found.agg(F.sum("total_submissions")).first()[0] == fx.table(spark, "/root/testdata/sf0.001", "events").count()


def test_a_batch_of_samples_is_grouped_once(spark, tmp_path, monkeypatch):
    """Rates, newest times and the carried samples read the grouped rows of a batch, which are kept."""
    leaves, plain = [], rates.counter_rate

    def watched(samples, *args):
        leaves.append(samples._jdf.queryExecution().withCachedData().collectLeaves().size())
        return plain(samples, *args)

    monkeypatch.setattr(rates, "counter_rate", watched)
    samples = fx.samples(fx.event_table_stream(spark, "/root/testdata/sf0.001"))
    rates.start_rates(samples, f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert leaves == [1] * fx.FILES


def test_messages_are_made_without_a_map_of_answers(spark):
    events = fx.table(spark, "/root/testdata/sf0.001", "events")
    messages = fx.event_messages(events)
    assert "map_filter" not in messages._jdf.queryExecution().optimizedPlan().toString()
    found = messages.select(F.from_json("value", "answers map<string,string>, data map<string,string>").alias("m"))
    found = found.select(F.map_entries(F.coalesce("m.answers", "m.data")).alias("answers"))
    wanted = fx.with_answer_map(fx.surveys(events)).select(F.map_entries("answers").alias("answers"))
    assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()


def test_bodies_are_kept_without_fixed_columns(spark, tmp_path, monkeypatch):
    """A batch keeps what was parsed; the columns that are the same in every row are added where it is written."""
    kept, plain = [], intake._keep
    monkeypatch.setattr(intake, "_keep", lambda df: kept.append(df) or plain(df))
    events = fx.event_table_stream(spark, "/root/testdata/sf0.001")
    intake.start_submissions(fx.request_bodies(events), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    assert len(kept) == fx.FILES and not {"metadata", "surveyId"} & set(kept[0].columns)
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    # searches inside a lambda end by an exception, and so does parsing a list as an object
    assert "array_position" not in plan and "StartsWith(ltrim" in plan.replace("startswith", "StartsWith")

    def flat(df):
        answers = [F.map_entries("answers").alias("answers"), F.map_keys("typed_answers").alias("typed")]
        return df.select("surveyId", "userId", "sessionId", "submittedAt", F.to_json("metadata").alias("metadata"), *answers)

    found = flat(read_batches(spark, f"{tmp_path}/out/survey_responses"))
    wanted = flat(submissions.normalise_submissions(fx.request_bodies(fx.table(spark, "/root/testdata/sf0.001", "events"))))
    assert found.exceptAll(wanted).isEmpty() and wanted.exceptAll(found).isEmpty()


def test_answers_keep_their_order_and_the_last_of_each_question(spark):
    texts = [
        '{"responses":[null,{"questionId":"a","answer":1},{"questionId":null,"answer":2},{"answer":3},'
        '{"questionId":"b","answer":"x"},{"questionId":"a","answer":null},{"questionId":"c"}]}',
        ' \t\r\n{"responses":[{"questionId":"a","answer":[1]}]} ', '{"responses":[]},{"responses":[]}', '],[{"responses":[]}', "[[]]", "", None,
    ]
    raw = spark.createDataFrame([(text,) for text in texts], "body string").select(
        "body", F.lit("s").alias("sessionId"), F.lit("u").alias("userAgent"), F.lit("r").alias("referer"),
        F.lit("i").alias("ipAddress"), F.timestamp_millis(F.lit(0)).alias("receivedAt"))
    found = submissions.decode_submissions(raw).select("valid", F.map_entries("answers").alias("answers")).collect()
    assert [r["valid"] for r in found] == [True, True, False, False, False, False, False]
    assert [[tuple(e) for e in r["answers"]] for r in found[:2]] == [[("c", None), ("a", None), ("b", "x")], [("a", "[1]")]]
