"""Operational tables: keep-last upsert, queue order, leases, schedules, outcomes, token buckets."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIGGERS = ("once", "delay", "interval", "cron", "dependency", "backfill")


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns (null first): a map-side maximum."""
    rest = [c for c in df.columns if c not in keys]
    hashed = [c for c, t in df.dtypes if not t.startswith("map")]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order], F.xxhash64(*hashed))).alias("__r"))
    return picked.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def class_name(c: Column) -> Column:
    """Execution class in lower case and trimmed; null where it has other than a-z, 0-9, _ and -."""
    low = F.lower(F.trim(c))
    return F.when(low.rlike("^[a-z0-9_-]+$"), low)


def claim(jobs: DataFrame, per_class: int, worker: str = "worker", now: datetime | None = None, lease_seconds: int = 60) -> DataFrame:
    """The first ``per_class`` queued jobs of each execution class by (submitted_at, job_id), as claimed."""
    order = Window.partitionBy("execution_class").orderBy("submitted_at", "job_id")
    first = jobs.where("state = 'queued'").withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= per_class)
    at = F.lit(now) if now else F.current_timestamp()
    return first.withColumn("state", F.lit("running")).withColumn("worker_id", F.lit(worker)).withColumn("claimed_at", at).withColumn("lease_expires_at", at + F.make_dt_interval(secs=F.lit(lease_seconds)))


def requeue_expired(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs whose lease has ended go back to the queue, without worker and lease."""
    gone = (F.col("state") == "running") & (F.col("lease_expires_at") <= now)
    gone = F.coalesce(gone, F.lit(False))
    return jobs.withColumns(
        {
            "requeued": gone,
            "state": F.when(gone, F.lit("queued")).otherwise(F.col("state")),
            "worker_id": F.when(~gone, F.col("worker_id")),
            "claimed_at": F.when(~gone, F.col("claimed_at")),
            "lease_expires_at": F.when(~gone, F.col("lease_expires_at")),
        }
    )


def submit(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by job_id: new jobs are queued and have no times but submitted_at."""
    reset = {c: F.lit(None).cast(t) for c, t in jobs.dtypes if c in ("claimed_at", "completed_at", "cancelled_at", "lease_expires_at", "worker_id", "error")}
    fresh = last_by(new, ["job_id"], ["submitted_at"]).withColumns({**reset, "state": F.lit("queued")})
    return jobs.join(fresh.select("job_id"), "job_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def finish(jobs: DataFrame, ends: DataFrame) -> DataFrame:
    """Applies (job_id, end_state, end_error, ended_at) to running jobs; others stay as they are."""
    if set(ends.columns) < {"job_id", "end_state", "end_error", "ended_at"}:
        raise ValueError("ends has job_id, end_state, end_error and ended_at")
    j = jobs.join(last_by(ends.select("job_id", "end_state", "end_error", "ended_at"), ["job_id"], ["ended_at"]), "job_id", "left")
    on = (F.col("state") == "running") & F.col("end_state").isin("succeeded", "failed", "cancelled")
    on = F.coalesce(on, F.lit(False))
    return j.withColumns(
        {
            "completed_at": F.when(on & F.col("end_state").isin("succeeded", "failed"), F.col("ended_at")).otherwise(F.col("completed_at")),
            "cancelled_at": F.when(on & (F.col("end_state") == "cancelled"), F.col("ended_at")).otherwise(F.col("cancelled_at")),
            "error": F.when(on, F.col("end_error")).otherwise(F.col("error")),
            "state": F.when(on, F.col("end_state")).otherwise(F.col("state")),
        }
    ).drop("end_state", "end_error", "ended_at")


def acquire(leases: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Leases after requests (job_id, worker_id, expires_at): granted if free, expired or the worker's own."""
    w = last_by(wanted, ["job_id"], ["expires_at"]).select("job_id", F.col("worker_id").alias("w"), F.col("expires_at").alias("e"))
    j = leases.select("job_id", "worker_id", "expires_at").join(w, "job_id", "full")
    take = F.col("w").isNotNull() & (F.col("worker_id").isNull() | (F.col("expires_at") <= now) | (F.col("worker_id") == F.col("w")))
    return j.select("job_id", F.when(take, F.col("w")).otherwise(F.col("worker_id")).alias("worker_id"), F.when(take, F.col("e")).otherwise(F.col("expires_at")).alias("expires_at"), F.coalesce(take, F.lit(False)).alias("granted"))


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Scheduled, not expired, and due by next_run_at or else due_at; with effective_due_at."""
    at = F.coalesce("next_run_at", "due_at")
    live = (F.col("state") == "scheduled") & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return schedules.where(live & (at <= now)).withColumn("effective_due_at", at)


def next_cron(expression: str, after: datetime) -> datetime | None:
    """The next time after ``after`` for ``*``, ``*/n`` and ``n`` in the minute (and second) field.

    Any other field than ``*`` elsewhere, or anything malformed, has no next time.
    """
    parts = expression.split()
    if len(parts) == 5:
        parts = ["0", *parts]
    if len(parts) != 6 or any(p != "*" for p in parts[2:]):
        return None
    seconds, minutes = (_field(p) for p in parts[:2])
    if not seconds or not minutes:
        return None
    t = after.replace(microsecond=0) + timedelta(seconds=1)
    hour = t.replace(minute=0, second=0)
    for hours in range(3):  # every hour has a matching minute and second
        base = hour + timedelta(hours=hours)
        for m in minutes:
            for s in seconds:
                at = base + timedelta(minutes=m, seconds=s)
                if at >= t:
                    return at
    return None


def _field(field: str) -> list[int] | None:
    if field == "*":
        return list(range(60))
    step = field.startswith("*/")
    try:
        n = int(field[2:] if step else field)
    except ValueError:
        return None
    if step:
        return list(range(0, 60, n)) if n > 0 else None
    return [n] if 0 <= n < 60 else None


@F.pandas_udf(T.TimestampType())
def cron_after(expression: pd.Series, after: pd.Series) -> pd.Series:
    out = []
    for e, a in zip(expression, after):
        ok = isinstance(e, str) and not pd.isna(a)
        t = next_cron(e, a.to_pydatetime().replace(tzinfo=None)) if ok else None
        out.append(pd.NaT if t is None else pd.Timestamp(t))
    return pd.Series(out, dtype="datetime64[us]")


def next_run(schedules: DataFrame, now: Column) -> DataFrame:
    """Adds next_run by the kind of trigger; null if there is none."""
    due_at = F.coalesce("next_run_at", "due_at")
    never = F.col("last_run_at").isNull()
    later = F.col("last_run_at") + F.make_dt_interval(secs=F.col("every_seconds"))
    every = F.when(F.col("every_seconds").isNull() | never, due_at).otherwise(later)
    cron = F.when(F.col("kind") == "cron", cron_after(F.when(F.col("kind") == "cron", F.col("expression")), F.coalesce("last_run_at", now)))
    once = F.when(never, due_at)
    caught = F.when(F.col("catch_up") & ~never & F.col("every_seconds").isNotNull(), later).otherwise(once)
    out = F.when(F.col("kind").isin("delay", "interval"), every).when(F.col("kind") == "cron", F.coalesce(cron, once)).when(F.col("kind").isin("dependency", "backfill"), caught).otherwise(once)
    ended = F.col("state").isin("done", "expired") | (F.col("expires_at") <= now)
    return schedules.withColumn("next_run", F.when(F.coalesce(ended, F.lit(False)), F.lit(None).cast("timestamp")).otherwise(out))


def mark_run(schedules: DataFrame, ran_at: Column) -> DataFrame:
    """Schedules after a run: last_run_at, next_run_at and state (done without a next run)."""
    ran = schedules.withColumn("last_run_at", ran_at)
    ran = next_run(ran, ran_at)
    return ran.withColumn("next_run_at", F.col("next_run")).withColumn("state", F.when(F.col("next_run").isNull(), "done").otherwise("scheduled")).drop("next_run")


def pause(schedules: DataFrame, which: Column) -> DataFrame:
    """Scheduled ones among ``which`` wait until they are resumed."""
    stops = F.coalesce(which & (F.col("state") == "scheduled"), F.lit(False))
    return schedules.withColumn("state", F.when(stops, "paused").otherwise(F.col("state")))


def resume(schedules: DataFrame, which: Column, now: Column) -> DataFrame:
    """Paused ones among ``which`` go on; those that expired meanwhile end."""
    goes = F.coalesce(which & (F.col("state") == "paused"), F.lit(False))
    ended = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return schedules.withColumn("state", F.when(goes & ended, "expired").when(goes, "scheduled").otherwise(F.col("state")))


def dispatch(schedules: DataFrame, now: Column) -> DataFrame:
    """One queued job per due schedule; its id follows from schedule and due time, so a retry adds none."""
    d = due(schedules, now)
    jid = F.sha2(F.concat_ws("|", F.col("schedule_id").cast("string"), F.col("effective_due_at").cast("string")), 256)
    return d.select(F.substring(jid, 1, 32).alias("job_id"), F.lit("schedule").alias("kind"), "schedule_id", "name", F.lit("queued").alias("state"), now.alias("submitted_at"))


def outcomes(steps: DataFrame, run: str = "run_id", state: str = "state") -> DataFrame:
    """Outcome of each run from its steps' states."""
    has = lambda s: F.coalesce(F.bool_or(F.col(state) == s), F.lit(False))
    g = steps.groupBy(run).agg(has("failed").alias("f"), has("cancelled").alias("c"), has("succeeded").alias("s"), F.count(F.lit(1)).alias("steps"))
    what = F.when(F.col("f") & F.col("s"), "partially_succeeded").when(F.col("f"), "failed").when(F.col("c"), "cancelled").otherwise("succeeded")
    return g.select(run, what.alias("outcome"), "steps")


class TokenBucket:
    """State of one key: admits a request at once, or after the wait until a token is there."""

    __slots__ = ("burst", "last", "rate", "tokens")

    def __init__(self, rate: float, burst: float, last: float | None = None, tokens: float | None = None):
        self.rate, self.burst = rate, burst
        self.last, self.tokens = last, burst if tokens is None else tokens

    def admit(self, at: float) -> float:
        """The wait in seconds of a request that arrives at ``at``."""
        now = at if self.last is None else max(at, self.last)
        if self.last is not None:
            self.tokens = min(self.burst, self.tokens + (now - self.last) * self.rate)
        wait = 0.0
        if self.tokens < 1:
            wait = (1 - self.tokens) / self.rate
            self.tokens = 1.0
        self.last = now + wait
        self.tokens -= 1
        return self.last - at


def rate_limit(df: DataFrame, key: str, at: str, tie: str, rate: float = 10.0, burst: int = 20) -> DataFrame:
    """Adds wait_seconds and admitted: each key's requests through its own token bucket, in time order.

    A sequential recurrence: keys are spread over tasks, and each task streams through its rows in
    order with one small state, so a hot key costs time but never memory.
    """
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            waits = []
            for k, t in zip(pdf["__k"], pdf["__t"]):
                if k != now:
                    now, state = k, TokenBucket(rate, burst)
                waits.append(state.admit(t))
            yield pd.DataFrame({key: pdf[key], tie: pdf[tie], "wait_seconds": waits})

    rows = df.select(key, tie, F.coalesce(F.col(key).cast("string"), F.lit("default")).alias("__k"), F.unix_micros(at).alias("__u")).where("__u is not null")
    rows = rows.repartition("__k").sortWithinPartitions("__k", "__u", tie).withColumn("__t", F.col("__u") / 1e6)
    out = rows.mapInPandas(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, wait_seconds double")
    return out.withColumn("admitted", F.col("wait_seconds") <= 0)


LISTINGS = {
    "jobs": ("created_at", "kind", "job_id"),
    "leases": ("expires_at", "job_id"),
    "runs": ("created_at", "run_id"),
    "dead_letters": ("-created_at", "run_id"),
    "metadata": ("namespace", "key"),
    "pipelines": ("project", "name"),
    "versions": ("pipeline", "-version"),
    "records": ("-created_at", "id"),
}


def listing(df: DataFrame, what: str, limit: int | None = None) -> DataFrame:
    """Rows in the order in which tables of that kind are listed; dead letters newest first."""
    order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in LISTINGS[what]]
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def next_versions(df: DataFrame, name: str, version: str) -> DataFrame:
    """The version that each name's next definition gets: one more than its highest, 1 for none."""
    return df.where(F.col(name).isNotNull()).groupBy(name).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def utc(year: int, month: int, day: int) -> datetime:
    return datetime(year, month, day, tzinfo=timezone.utc)
