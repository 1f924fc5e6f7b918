"""Metric operators against a direct computation."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from canvass.operators import samples

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def make(seed=1, count=400, span=7200):
    """Two series of a counter with resets, at uneven times."""
    rng = random.Random(seed)
    rows = []
    for instance in ("a", "b"):
        value = 0.0
        for second in sorted(rng.sample(range(span), count // 2)):
            value = 0.0 if rng.random() < 0.05 else value + rng.randint(0, 9)
            rows.append(("cpu", {"instance": instance, "mode": "idle"}, T0 + dt.timedelta(seconds=second), value))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp, value double")


def rate(points):
    if len(points) < 2:
        return None
    total = sum(b - a if b >= a else b for (_, a), (_, b) in zip(points, points[1:]))
    return total / (points[-1][0] - points[0][0]).total_seconds()


def series(rows):
    by = defaultdict(list)
    for _, labels, ts, value in rows:
        by[labels["instance"]].append((ts, value))
    return by


@pytest.mark.parametrize("bucket", [300, 900, 100_000])
def test_rate_at_samples(spark, bucket):
    rows = make()
    expected = {
        (name, ts): rate([p for p in points if ts - dt.timedelta(seconds=300) < p[0] <= ts])
        for name, points in series(rows).items() for ts, _ in points
    }
    out = samples.counter_rate(frame(spark, rows), 300, bucket).select(
        F.col("labels")["instance"].alias("i"), F.unix_micros("ts").alias("us"), "rate").collect()
    got = {(r["i"], T0 + dt.timedelta(microseconds=r["us"] - int(T0.timestamp() * 1e6))): r["rate"] for r in out}
    assert got.keys() == expected.keys() and len(out) == len(rows)
    for key, value in expected.items():
        assert got[key] == (None if value is None else pytest.approx(value)), key


@pytest.mark.parametrize("step", [60, 300, 450])
def test_rate_on_grid(spark, step):
    rows = make(seed=2)
    expected = {}
    for name, points in series(rows).items():
        for k in range(0, 7200 + 600, 1):
            if k % step:
                continue
            t = T0 + dt.timedelta(seconds=k)
            inside = [p for p in points if t - dt.timedelta(seconds=300) < p[0] <= t]
            if inside:
                expected[name, k] = rate(inside)
    out = samples.rate_on_grid(frame(spark, rows), 300, step, 900).select(
        F.col("labels")["instance"].alias("i"), F.unix_seconds("eval_ts").alias("s"), "rate").collect()
    got = {(r["i"], r["s"] - int(T0.timestamp())): r["rate"] for r in out}
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] == (None if value is None else pytest.approx(value)), key


def test_busy_percent(spark):
    rows = [(samples.CPU_SECONDS, {"instance": "a", "cpu": c, "mode": "idle"}, T0 + dt.timedelta(seconds=s), s * share)
            for c, share in (("0", 0.5), ("1", 0.9)) for s in (10, 40)]
    rows += [(samples.CPU_SECONDS, {"instance": "a", "cpu": "0", "mode": "user"}, T0 + dt.timedelta(seconds=s), s * 3.0) for s in (10, 40)]
    rows += [("load", {"instance": "a", "mode": "idle"}, T0 + dt.timedelta(seconds=s), s * 7.0) for s in (10, 40)]
    out = samples.busy_percent(frame(spark, rows)).orderBy("eval_ts").collect()
    assert len(out) == 5 and all(r["busy_pct"] == pytest.approx(30.0) for r in out)


def test_latest_and_selection(spark):
    rows = [("m", {"x": "1", "y": "2"}, T0, 1.0), ("m", {"y": "2", "x": "1"}, T0 + dt.timedelta(seconds=9), 2.0),
            ("m", {"x": "3"}, T0, 5.0), ("n", {"x": "3"}, T0, 7.0)]
    df = frame(spark, rows)
    newest = {(r["metric"], tuple(sorted(r["labels"].items()))): r["value"] for r in samples.latest_samples(df).collect()}
    assert newest == {("m", (("x", "1"), ("y", "2"))): 2.0, ("m", (("x", "3"),)): 5.0, ("n", (("x", "3"),)): 7.0}
    assert samples.select_metric(df, "m", x="3").count() == 1
    at = T0 + dt.timedelta(seconds=8)
    assert samples.latest_samples(df, at, 5).count() == 0
    assert samples.latest_samples(df, at).filter("value = 1.0").count() == 1


def test_bucket_must_cover_the_range(spark):
    with pytest.raises(ValueError):
        samples.counter_rate(frame(spark, make()), 300, 60)
