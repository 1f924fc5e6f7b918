"""Word index, newest-days search, reports of changed days, tables of one commit, redelivery and late rows."""

import datetime as dt
import json
import shutil

import pytest
from pyspark.sql import functions as F

from canvass.functions.text import matches_any
from canvass.operators import reports, token_index
from canvass.operators.samples import counter_rate
from canvass.plans import batch_report, incremental
from canvass.plans.batch_report import land_surveys, read_reports, write_reports
from canvass.sinks import files, tables
from canvass import schemas
from canvass.sources import evolving
from canvass.sources.logs import Input, days_of, newest_hits, union_streams
from canvass.streaming import intake, late, queries, rates
from tests.conftest import SMALL, plan_of

DAY = dt.datetime(2024, 1, 1)


# --- word index ------------------------------------------------------------------------

def test_index_answers_like_a_scan_and_reads_no_text(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("doc_id").cast("int") % 5))
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, "en", None, 0, None), (10**6 + 1, "--", "en", None, 0, None)], docs.schema))
    path = str(tmp_path / "index")
    for k in range(3):
        token_index.add_to_index(docs.filter(F.pmod("doc_id", F.lit(3)) == k), path, k, "doc_id", day="day", keep=("lang",))
    for query in ("with license", "THE", "nowhere-word", "", "?!"):
        want = {(r["doc_id"], r["lang"]) for r in docs.filter(F.coalesce(matches_any(F.coalesce("text", F.lit("")), query), F.lit(False))).collect()}
        found = token_index.matching(spark, path, query)
        assert {(r["doc"], r["lang"]) for r in found.collect()} == want
        assert "text" not in plan_of(found).replace("context", "")
    plan = plan_of(token_index.matching(spark, path, "license"))
    assert "PartitionFilters: [" in plan and "EqualTo(token,license)" in plan.replace(" ", "")
    days = {r["day"]: r["docs"] for r in token_index.hits_by_day(spark, path, "the").collect()}
    assert sum(days.values()) == token_index.matching(spark, path, "the").count() and len(days) > 1


def test_repeated_batch_replaces_its_postings_and_parts_are_folded(spark, tmp_path):
    path = str(tmp_path / "index")
    frame = lambda k: spark.createDataFrame([(k, f"word{k} common")], "id long, text string")
    for k in [*range(11), 10]:
        token_index.add_to_index(frame(k), path, k, "id")
    assert token_index.matching(spark, path, "common").count() == 11
    assert token_index.matching(spark, path, "word10 word3").count() == 2
    assert len(json.loads(files.read_text(spark, f"{path}/_parts.json"))["parts"]) < 11


def logs_of(spark, root, days=12, per_day=5):
    rows = [(d * 100 + i, f"disk {'full' if (d + i) % 3 else 'ok'}", DAY + dt.timedelta(days=d, minutes=i), "logs") for d in range(days) for i in range(per_day)]
    frame = spark.createDataFrame(rows, "id long, message string, `@timestamp` timestamp, index_name string").withColumn("index_date", F.to_date("@timestamp"))
    undated = spark.createDataFrame([(9999, "disk full", None, "logs", None)], frame.schema)
    whole = frame.unionByName(undated)
    tables.write_partitioned(whole, root, ["index_name", "index_date"])
    return whole


def test_newest_days_are_opened_first(spark, tmp_path):
    root, index = str(tmp_path / "logs"), str(tmp_path / "index")
    whole = logs_of(spark, root)
    assert len(days_of(spark, root)) == 13 and days_of(spark, root)[-1] is None and days_of(spark, root, "surveys*") == []
    hits, opened = newest_hits(spark, root, "full", 4, newest=("@timestamp", "id"))
    want = [r["id"] for r in whole.filter("message LIKE '%full'").orderBy(F.desc("@timestamp"), F.desc("id")).limit(4).collect()]
    assert [r["id"] for r in hits.collect()] == want and len(opened) == 2  # three or four hits a day
    # rare words: every day is opened, unless the index knows where they are
    everything, opened = newest_hits(spark, root, "full", 1000, newest=("@timestamp", "id"))
    assert everything.count() == whole.filter("message LIKE '%full'").count() and len(opened) == 13
    token_index.add_to_index(whole.withColumn("message", F.when(F.col("id") == 2, "disk broken").otherwise(F.col("message"))), index, 0, "id", "message", "index_date")
    marked = spark.createDataFrame([(2, "disk broken", DAY, "logs", DAY.date())], whole.schema)
    tables.write_partitioned(marked, root, ["index_name", "index_date"])
    rare, opened = newest_hits(spark, root, "broken", 3, newest=("@timestamp", "id"), index=index)
    assert [r["id"] for r in rare.collect()] == [2] and opened == [DAY.date()]
    assert newest_hits(spark, root, "nothing", 3, index=index)[1] == []


# --- reports of changed days -----------------------------------------------------------

def submissions(spark, day, *people, rating="5"):
    rows = [("s", p, f"{p}-{day}", {"spring_performance": rating, "java_tech_interest": "Spark, Kafka", "integration_quality": str(len(p))},
             DAY + dt.timedelta(days=day, hours=i)) for i, p in enumerate(people)]
    return spark.createDataFrame(rows, "surveyId string, userId string, sessionId string, answers map<string,string>, submittedAt timestamp")


def same_tables(spark, landed, out, tmp_path, exact=True):
    fresh = str(tmp_path / "fresh" / str(len(list(tmp_path.iterdir()))) / out.rsplit("/", 1)[-1])
    write_reports(spark.read.parquet(landed), fresh, exact)
    for name in batch_report.REPORTS:
        a, b = (sorted(map(str, read_reports(spark, x)[name].collect())) for x in (out, fresh))
        assert a == b, name
    shutil.rmtree(fresh)


def test_only_changed_days_are_read(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    land_surveys(submissions(spark, 0, "a", "b").unionAll(submissions(spark, 1, "a")).unionAll(submissions(spark, 2, "c")), landed)
    assert incremental.refresh_reports(spark, landed, out) == {"read": ["2024-01-01", "2024-01-02", "2024-01-03"], "gone": []}
    same_tables(spark, landed, out, tmp_path)
    assert incremental.refresh_reports(spark, landed, out)["read"] == []
    # a day grows, another shrinks
    land_surveys(submissions(spark, 1, "a", "x", "y", rating="2"), landed)
    assert incremental.refresh_reports(spark, landed, out)["read"] == ["2024-01-02"]
    same_tables(spark, landed, out, tmp_path)
    land_surveys(submissions(spark, 0, "b").withColumn("submittedAt", F.lit(DAY).cast("timestamp")), landed)
    assert incremental.refresh_reports(spark, landed, out)["read"] == ["2024-01-01"]
    same_tables(spark, landed, out, tmp_path)
    # a day goes, rows without a day come
    shutil.rmtree(f"{landed}/submitted_date=2024-01-03")
    land_surveys(submissions(spark, 5, "n").withColumn("submittedAt", F.lit(None).cast("timestamp")), landed)
    assert incremental.refresh_reports(spark, landed, out) == {"read": [""], "gone": ["2024-01-03"]}
    same_tables(spark, landed, out, tmp_path)
    for k in range(9):  # parts are put together
        land_surveys(submissions(spark, 10 + k, "a", f"p{k}"), landed)
        incremental.refresh_reports(spark, landed, out)
    assert len(json.loads(files.read_text(spark, f"{out}/days/_parts.json"))["parts"]) <= incremental.FOLD
    same_tables(spark, landed, out, tmp_path)
    with pytest.raises(ValueError):
        incremental.refresh_reports(spark, landed, out, exact=False)  # its partials hold no sketches


def test_a_changed_day_is_all_that_is_scanned(spark, tmp_path, monkeypatch):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    land_surveys(submissions(spark, 0, "a").unionAll(submissions(spark, 1, "b")), landed)
    incremental.refresh_reports(spark, landed, out)
    land_surveys(submissions(spark, 1, "c"), landed)
    opened, plain = [], tables.overwrite
    monkeypatch.setattr(incremental, "overwrite", lambda df, path: (opened.extend(df.inputFiles()), plain(df, path)))
    incremental.refresh_reports(spark, landed, out)
    assert opened and all("submitted_date=2024-01-02" in f for f in opened if "/landed/" in f)


def test_sketches_of_days_add_up(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "out")
    people = spark.range(30000).select(F.lit("s").alias("surveyId"), F.concat(F.lit("u"), F.col("id") % 9000).alias("userId"), F.concat(F.lit("s"), "id").alias("sessionId"),
                                       F.create_map(F.lit("spring_performance"), F.lit("4")).alias("answers"),
                                       (F.lit(DAY).cast("timestamp") + F.expr("make_dt_interval(cast(id % 3 AS INT), 5)")).alias("submittedAt"))
    land_surveys(people, landed)
    incremental.refresh_reports(spark, landed, out, exact=False)
    hour = read_reports(spark, out)["hourly_report"].first()
    assert hour["submissions"] == 30000 and abs(hour["users"] - 9000) <= 4 * 1.04 / 128 * 9000
    days = read_reports(spark, out)["daily_stats"].collect()
    assert len(days) == 3 and all(abs(r["unique_sessions"] - 10000) <= 4 * 1.04 / 128 * 10000 for r in days)
    span = reports.people_from(reports.people_sketches(people.filter("userId IS NULL")))
    assert span.count() == 0


def test_readers_see_the_old_tables_until_all_new_ones_are_complete(spark, tmp_path, monkeypatch):
    out, first = str(tmp_path / "out"), submissions(spark, 0, "a")
    monkeypatch.setattr(tables, "overwrite", lambda df, path: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):  # a run that fails before anything was stored
        write_reports(first, out)
    monkeypatch.undo()
    write_reports(first, out)
    opened = read_reports(spark, out)
    plain = tables.overwrite

    def failing(df, path):
        if path.endswith("/hourly_report"):
            raise RuntimeError("lost")
        plain(df, path)

    monkeypatch.setattr(tables, "overwrite", failing)
    with pytest.raises(RuntimeError):
        write_reports(submissions(spark, 1, "a", "b"), out)
    assert read_reports(spark, out)["daily_stats"].first()["total_submissions"] == 1
    monkeypatch.undo()
    write_reports(submissions(spark, 1, "a", "b"), out)
    assert read_reports(spark, out)["daily_stats"].first()["total_submissions"] == 2
    assert opened["daily_stats"].first()["total_submissions"] == 1  # the generation before is still there


def test_readers_survive_a_fold(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1,)], "a int")
    for k in range(8):
        tables.write_batch(frame, path, k)
    opened = tables.read_batches(spark, path)
    tables.write_batch(frame, path, 8)  # folds the first eight
    assert opened.count() == 8 and tables.read_batches(spark, path).count() == 9
    for k in range(9, 17):
        tables.write_batch(frame, path, k)
    assert tables.read_batches(spark, path).count() == 17
    assert len(files.folders(spark, f"{path}/data")) < 17


# --- redelivery and late rows ----------------------------------------------------------

def lines(folder, name, *values):
    (folder / name).write_text("\n".join(values) + "\n")


def test_a_line_of_two_batches_is_stored_once(spark, tmp_path):
    source, out, checkpoints = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    source.mkdir()
    line = '{"type":"survey","question":"q","answer":"a","timestamp":%d}'
    stream = lambda: spark.readStream.option("maxFilesPerTrigger", 1).text(str(source))
    lines(source, "1", line % 1, line % 2, line % 2)
    lines(source, "2", line % 2, line % 3)
    intake.start_router(stream(), out, checkpoints, redelivery="10 minutes").awaitTermination()
    lines(source, "3", line % 1, line % 4, "oops")  # after a restart
    intake.start_router(stream(), out, checkpoints, redelivery="10 minutes").awaitTermination()
    assert tables.read_batches(spark, f"{out}/survey_responses").count() == 4
    assert tables.read_batches(spark, f"{out}/forwarded").count() == 5


def test_kept_and_late_rows_are_all_rows_across_a_restart(spark, tmp_path):
    source, out, checkpoints = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    source.mkdir()
    row = lambda i, m: json.dumps({"id": i, "at": (DAY + dt.timedelta(minutes=m)).isoformat()})

    def run():
        stream = spark.readStream.schema("id int, at timestamp").option("maxFilesPerTrigger", 1).json(str(source))
        late.start_keeping_late(stream, out, checkpoints, "rows", "at", "10 minutes").awaitTermination()

    lines(source, "1", row(1, 0), row(2, 60), row(3, 5))  # nothing before it: in time
    run()
    lines(source, "2", row(4, 49), row(5, 50), row(6, 61), '{"id": 7}')
    run()
    lines(source, "3", row(8, 50), row(9, 51))  # the bound is 51 minutes now
    run()
    ids = lambda name: {r["id"] for r in tables.read_batches(spark, f"{out}/{name}").collect()}
    assert ids("rows") == {1, 2, 3, 5, 6, 7, 9} and ids("rows_late") == {4, 8}
    assert json.loads(files.read_text(spark, f"{out}/rows_bounds/times.json"))["times"][-1][0] == 2


# --- rates and unions of streams -------------------------------------------------------

def test_rates_of_a_stream_are_those_of_the_table(spark, tmp_path):
    """In several runs, with late samples, a reset, two series and one sample that is too late."""
    source, out, checkpoints = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "c")
    source.mkdir()
    seconds = {"1": [(0, "a", 0), (60, "a", 10), (200, "a", 30), (100, "b", 7)], "2": [(150, "a", 25), (260, "a", 5), (400, "b", 9)],
               "3": [(290, "a", 8), (5000, "a", 1), (280, "b", 8)], "4": [(5100, "a", 4), (4700, "a", 0), (10, "a", 2)]}

    def rows(items):
        return [json.dumps({"metric": "m", "labels": {"i": i}, "ts": (DAY + dt.timedelta(seconds=s)).isoformat(), "value": v}) for s, i, v in items]

    for name, items in seconds.items():
        lines(source, name, *rows(items))
        stream = spark.readStream.schema(rates.SAMPLE).json(str(source))
        rates.start_rates(stream, out, checkpoints, 300, 600).awaitTermination()
    whole = spark.read.schema(rates.SAMPLE).json(str(source)).filter(f"NOT (labels['i'] = 'a' AND value = 2)")
    say = lambda df: sorted(str(tuple(r)) for r in df.select("metric", "labels", "ts", "value", F.round("rate", 9)).collect())
    assert say(rates.read_rates(spark, out)) == say(counter_rate(whole, 300))
    late_one = tables.read_batches(spark, f"{out}/late_samples").collect()
    assert [r["value"] for r in late_one] == [2.0]
    assert tables.read_snapshot(spark, f"{out}/carried").count() < whole.count()


@pytest.mark.parametrize("waiting", [True, False])
def test_a_stalled_input_holds_windows_open_or_loses_rows(spark, tmp_path, waiting):
    out, checkpoints = str(tmp_path / "out"), str(tmp_path / "c")
    for name in ("fast", "slow"):
        (tmp_path / name).mkdir()
    say = lambda h: json.dumps({"level": "I", "at": (DAY + dt.timedelta(hours=h)).isoformat()})

    def run():
        inputs = [Input(spark.readStream.schema("level string, at timestamp").json(str(tmp_path / n)).withColumn("role", F.lit(n)), "at", "10 minutes")
                  for n in ("fast", "slow")]
        whole = union_streams(*inputs, wait_for_slowest=waiting).select("level", "role", "event_time")
        queries.start_log_counts(whole, out, checkpoints).awaitTermination()

    try:
        lines(tmp_path / "fast", "1", say(0), say(1))
        lines(tmp_path / "slow", "1", say(0))
        run()
        lines(tmp_path / "fast", "2", say(5), say(6))  # the slow one stalls
        run()
        closed = tables.read_batches(spark, f"{out}/log_counts").count()
        lines(tmp_path / "slow", "2", say(0), say(9))
        lines(tmp_path / "fast", "3", say(9))
        run()
        found = {r["role"]: r["n"] for r in tables.read_batches(spark, f"{out}/log_counts").groupBy("role").agg(F.sum("n").alias("n")).collect()}
        assert (closed == 0) == waiting
        assert found == ({"fast": 4, "slow": 2} if waiting else {"fast": 4, "slow": 1})
    finally:
        spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")


# --- answers that become columns -------------------------------------------------------

def test_files_of_several_versions_are_read_as_one(spark, tmp_path):
    path = str(tmp_path / "landed")
    schema = "surveyId string, userId string, sessionId string, answers map<string,string>, submittedAt timestamp"

    def day_of(day, *answers):
        return spark.createDataFrame([("s", "u", f"{day}-{i}", a, DAY + dt.timedelta(days=day)) for i, a in enumerate(answers)], schema)

    old = {"spring_performance": "5", "rare": "x", "surveyId": "clash"}
    evolving.land_evolving(day_of(0, old, *[{"spring_performance": "4"}] * 9), path, share=0.5)
    assert [v["version"] for v in evolving.versions(spark, path)] == [1]  # two keys are rare, one has a column
    new = [{"spring_performance": "3", "rare": "y", "Size": "7"}, {"Size": "9", "size": "1"}, {"tags": '["a", "b"]', "Size": None}]
    landed = evolving.land_evolving(day_of(1, *new), path, share=0.3)
    last = evolving.versions(spark, path)[-1]
    assert last["version"] == 2 and set(last["keys"]) - set(schemas.HOT_ANSWERS) == {"Size", "rare", "tags"}
    assert last["kinds"]["tags"] == "ARRAY<STRING>" and last["kinds"]["Size"].startswith(("DECIMAL", "BIGINT"))
    rows = {r["sessionId"]: (r["spring_performance"], r["rare"], r["Size"], r["tags"]) for r in landed.collect()}
    assert rows["0-0"] == ("5", "x", None, None) and rows["0-3"] == ("4", None, None, None)
    assert rows["1-0"] == ("3", "y", "7", None) and rows["1-2"] == (None, None, None, '["a", "b"]')
    assert evolving.read_evolving(spark, path).filter("Size = '9'").count() == 1
    evolving.land_evolving(day_of(1, new[1]), path, share=0.3)  # nothing new: no further version
    assert len(evolving.versions(spark, path)) == 2 and evolving.read_evolving(spark, path).count() == 11
