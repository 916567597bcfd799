from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.operators import ops as O

NOW = datetime(2025, 1, 1, 12)
JOB = "job_id string, state string, execution_class string, worker_id string, submitted_at timestamp, claimed_at timestamp, completed_at timestamp, cancelled_at timestamp, lease_expires_at timestamp, error string"


def jobs(spark, *rows):
    return spark.createDataFrame([(j, s, c, w, t, None, None, None, lease, None) for j, s, c, w, t, lease in rows], JOB)


def test_claim_is_fifo_per_class(spark):
    t = [NOW + timedelta(seconds=i) for i in range(3)]
    df = jobs(spark, ("b", "queued", "cpu", None, t[0], None), ("a", "queued", "cpu", None, t[0], None), ("c", "queued", "cpu", None, t[1], None), ("d", "queued", "io", None, t[2], None), ("e", "running", "io", "w", t[0], None))
    out = O.claim(df, 2, "w1", NOW).orderBy("execution_class", "slot").collect()
    assert [(r.job_id, r.worker_id, r.lease_expires_at) for r in out] == [(j, "w1", NOW + timedelta(seconds=60)) for j in ("a", "b", "d")]


def test_requeue(spark):
    df = jobs(spark, ("a", "running", "x", "w", NOW, NOW), ("b", "running", "x", "w", NOW, NOW + timedelta(1)), ("c", "running", "x", "w", NOW, None), ("d", "failed", "x", "w", NOW, NOW))
    out = {r.job_id: (r.state, r.worker_id) for r in O.requeue_expired(df, F.lit(NOW)).collect()}
    assert out == {"a": ("queued", None), "b": ("running", "w"), "c": ("running", "w"), "d": ("failed", "w")}


def test_submit_and_finish(spark):
    df = jobs(spark, ("a", "failed", "x", "w", NOW, NOW), ("b", "running", "x", "w", NOW, NOW))
    again = O.submit(df, df.where("job_id = 'a'").unionByName(jobs(spark, ("n", "failed", "x", "q", NOW, None))))
    assert {(r.job_id, r.state, r.worker_id) for r in again.collect()} == {("a", "queued", None), ("b", "running", "w"), ("n", "queued", None)}
    ends = spark.createDataFrame([("a", "succeeded", None, NOW), ("b", "failed", "why", NOW)], "job_id string, end_state string, end_error string, ended_at timestamp")
    assert {(r.job_id, r.state, r.error) for r in O.finish(df, ends).collect()} == {("a", "failed", None), ("b", "failed", "why")}


def test_leases(spark):
    kind = "job_id string, worker_id string, expires_at timestamp"
    held = spark.createDataFrame([("a", "w", NOW), ("b", "w", NOW + timedelta(1)), ("c", "me", NOW + timedelta(1))], kind)
    want = spark.createDataFrame([(j, "me", NOW + timedelta(2)) for j in "abcd"], kind)
    assert {r.job_id: r.granted for r in O.acquire(held, want, F.lit(NOW)).collect()} == {"a": True, "b": False, "c": True, "d": True}


@pytest.mark.parametrize(
    ("expression", "after", "want"),
    [
        ("* * * * *", "2025-01-01 10:00:30", "2025-01-01 10:01:00"),
        ("*/15 * * * *", "2025-01-01 10:59:59.5", "2025-01-01 11:00:00"),
        ("*/15 * * * *", "2025-01-01 10:45:00", "2025-01-01 11:00:00"),
        ("5 * * * *", "2025-12-31 23:30:00", "2026-01-01 00:05:00"),
        ("30 */20 * * * *", "2025-01-01 10:00:30", "2025-01-01 10:20:30"),
        ("5 3 * * *", "2025-01-01 10:00:00", None), ("*/0 * * * *", "2025-01-01 10:00:00", None), ("x * * * *", "2025-01-01 10:00:00", None), ("60 * * * *", "2025-01-01 10:00:00", None), ("* * *", "2025-01-01 10:00:00", None),
    ],
)
def test_cron(expression, after, want):
    assert O.next_cron(expression, datetime.fromisoformat(after)) == (want and datetime.fromisoformat(want))


def test_next_run_by_kind(spark):
    d, last = NOW - timedelta(1), NOW - timedelta(hours=2)
    rows = [
        ("once", None, None, False, d, None, None, "scheduled", None, d), ("once", None, None, False, d, last, None, "scheduled", None, None), ("interval", None, 60, False, d, last, None, "scheduled", None, last + timedelta(seconds=60)),
        ("delay", None, 60, False, d, None, None, "scheduled", None, d), ("interval", None, None, False, d, last, None, "scheduled", None, d), ("cron", "*/15 * * * *", None, False, d, last, None, "scheduled", None, last + timedelta(minutes=15)),
        ("cron", "bad", None, False, d, last, None, "scheduled", None, None), ("cron", None, None, False, d, None, None, "scheduled", None, d), ("backfill", None, 60, True, d, last, None, "scheduled", None, last + timedelta(seconds=60)),
        ("dependency", None, 60, False, d, last, None, "scheduled", None, None), ("once", None, None, False, d, None, NOW, "scheduled", None, None), ("once", None, None, False, d, None, None, "done", None, None), ("once", None, None, False, d, None, None, "scheduled", last, last),
    ]
    kind = "kind string, expression string, every_seconds long, catch_up boolean, due_at timestamp, last_run_at timestamp, expires_at timestamp, state string, next_run_at timestamp, want timestamp"
    for r in O.next_run(spark.createDataFrame(rows, kind), F.lit(NOW)).collect():
        assert r.next_run == r.want, r


def test_due_and_mark(spark):
    kind = "schedule_id int, name string, kind string, expression string, every_seconds long, catch_up boolean, due_at timestamp, last_run_at timestamp, expires_at timestamp, state string, next_run_at timestamp"
    row = lambda i, **k: tuple({"schedule_id": i, "name": "n", "kind": "once", "expression": None, "every_seconds": None, "catch_up": False, "due_at": NOW, "last_run_at": None, "expires_at": None, "state": "scheduled", "next_run_at": None, **k}.values())
    df = spark.createDataFrame([row(1), row(2, due_at=NOW + timedelta(1)), row(3, state="paused"), row(4, expires_at=NOW), row(5, next_run_at=NOW + timedelta(1)), row(6, kind="interval", every_seconds=60)], kind)
    assert {r.schedule_id for r in O.due(df, F.lit(NOW)).collect()} == {1, 6}
    marked = {r.schedule_id: (r.state, r.next_run_at) for r in O.mark_run(df, F.lit(NOW)).collect()}
    assert marked[1] == ("done", None)
    assert marked[6] == ("scheduled", NOW + timedelta(seconds=60))
    assert O.dispatch(df, F.lit(NOW)).select("job_id").distinct().count() == 2


def test_outcomes(spark):
    rows = [("a", "succeeded"), ("b", "failed"), ("b", "succeeded"), ("c", "failed"), ("d", "cancelled"), ("d", "succeeded"), ("e", None)]
    out = {r.run_id: r.outcome for r in O.outcomes(spark.createDataFrame(rows, "run_id string, state string")).collect()}
    assert out == {"a": "succeeded", "b": "partially_succeeded", "c": "failed", "d": "cancelled", "e": "succeeded"}


@given(st.lists(st.floats(0, 50), max_size=40))
@settings(max_examples=60, deadline=None)
def test_bucket_never_exceeds_its_rate(times):
    bucket, rate, burst = O.TokenBucket(2.0, 3), 2.0, 3
    admitted = [t + bucket.admit(t) for t in sorted(times)]
    assert admitted == sorted(admitted)
    for i, a in enumerate(admitted):
        assert sum(1 for b in admitted[: i + 1] if b > a - 1.0) <= burst + rate * 1.0 + 1e-6


def test_rate_limit_table(spark):
    rows = [("k", NOW + timedelta(seconds=s), i) for i, s in enumerate((0, 0, 0, 10))] + [(None, NOW, 9), ("k", None, 10)]
    out = {r.n: r.wait_seconds for r in O.rate_limit(spark.createDataFrame(rows, "k string, at timestamp, n int"), "k", "at", "n", rate=1.0, burst=2).collect()}
    assert out == {0: 0.0, 1: 0.0, 2: 1.0, 3: 0.0, 9: 0.0}


def test_class_names(spark):
    df = spark.createDataFrame([(" CPU ",), ("a b",), (None,), ("",)], "c string")
    assert [r[0] for r in df.select(O.class_name(F.col("c"))).collect()] == ["cpu", None, None, None]


def test_pause_and_resume(spark):
    rows = [("a", "scheduled", None), ("b", "done", None), ("c", "paused", NOW), ("d", "paused", NOW + timedelta(1)), ("e", None, None), ("f", "paused", None)]
    df = spark.createDataFrame(rows, "schedule_id string, state string, expires_at timestamp")
    paused = {r.schedule_id: r.state for r in O.pause(df, F.col("schedule_id") != "z").collect()}
    assert paused == {"a": "paused", "b": "done", "c": "paused", "d": "paused", "e": None, "f": "paused"}
    back = {r.schedule_id: r.state for r in O.resume(df, F.col("schedule_id") != "f", F.lit(NOW)).collect()}
    assert back == {"a": "scheduled", "b": "done", "c": "expired", "d": "scheduled", "e": None, "f": "paused"}


def test_listing_orders(spark):
    df = spark.createDataFrame([("p", 1), ("p", 3), ("a", 2)], "pipeline string, version int")
    assert [tuple(r) for r in O.listing(df, "versions").collect()] == [("a", 2), ("p", 3), ("p", 1)]
