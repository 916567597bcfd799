"""Registered web, filter and operational queries, with their SQL."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.keys import uuid_hex, uuid_text
from docloom.operators import ops as O
from docloom.operators import vectors as V
from docloom.operators import web as W
from docloom.plans import conditions
from docloom.sources import fetch
from docloom.storage import table

NOW = datetime(2025, 6, 1, tzinfo=timezone.utc)
NOW_SQL = "timestamptz '2025-06-01 00:00:00+00'"
CONDITION = "1 < l_quantity <= 24 and (l_returnflag == 'R' or not l_discount < 0.05) and exists(l_tax)"


def _pages(spark, sf) -> DataFrame:
    return V.upsert(table(spark, sf, "scrape_requests").where("page_id is not null"), "loaded_at", ["page_id"])


def scrape_pages(spark: SparkSession, sf: str) -> DataFrame:
    out = W.scrape(_pages(spark, sf).where("html is not null"))
    return out.select("page_id", "title", F.sha2("text", 256).alias("text_sha256"), F.size("links").alias("links"), F.array_join("headings", "|").alias("headings"))


def crawl_bfs(spark, sf):
    pages = _pages(spark, sf).select("url", "html").where("url is not null")
    seed = pages.agg(F.min("url")).first()[0]
    return W.Crawl(pages, seed, max_depth=2, max_pages=50).run().select("url", "depth", "parent_url", "visit", "found", "title")


def monitor_changes(spark, sf):
    seen = table(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("body"))
    return W.monitor(seen, "user_id", "body", "ts", "event_id").select("event_id", "user_id", "body_sha256", "previous_sha256", "changed")


def archive_segments(spark, sf):
    sized = _pages(spark, sf).select("page_id", F.octet_length("html").alias("size"))
    return W.archive_segments(sized, "size", "page_id", writers=4, max_bytes=1 << 17, max_records=50)


def archive_headers(spark, sf):
    p = _pages(spark, sf).where("html is not null")
    head = W.archive_headers(F.sha2("url", 256), F.col("html"), F.create_map(F.lit("seed url!"), "url"), F.create_map(F.lit("Content-Type"), F.lit("text/html")))
    return p.where("url is not null").select("page_id", F.explode(head).alias("name", "value"))


def provenance_envelopes(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("document_id"), "text", F.create_map(F.lit("lang"), "lang").alias("metadata"))
    out = W.envelopes(docs, "document", "1.0", ["document_id", "text"])
    return out.select("document_id", "resource_type", "schema_version", "fingerprint", "resource_id")


def lineage_ancestors(spark, sf):
    """Chunk, page and site of every vector record, and all that lies above each."""
    v = table(spark, sf, "vector_records").where("document_id is not null and record_id is not null")
    up = v.select(F.concat(F.lit("record/"), "record_id").alias("child"), F.concat(F.lit("page/"), "document_id").alias("parent"))
    top = v.select(F.concat(F.lit("page/"), "document_id").alias("child"), F.concat(F.lit("shelf/"), F.length("document_id").cast("string")).alias("parent"))
    return W.ancestors(up.unionByName(top))


def condition_filter(spark, sf):
    return conditions.where(table(spark, sf, "lineitem"), CONDITION).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


def _jobs(spark, sf) -> DataFrame:
    jobs = table(spark, sf, "worker_jobs").withColumn("job_id", uuid_hex(F.col("job_id"))).withColumn("execution_class", O.class_name(F.col("execution_class")))
    return O.last_by(jobs, ["job_id"], ["loaded_at"])


def queue_claim(spark, sf):
    return O.claim(_jobs(spark, sf), 5, now=NOW).select("execution_class", "slot", uuid_text(F.col("job_id")).alias("job_id"), "state", "claimed_at", "lease_expires_at")


def queue_requeue(spark, sf):
    out = O.requeue_expired(_jobs(spark, sf), F.lit(NOW))
    return out.groupBy("execution_class", "state", "requeued").agg(F.count(F.lit(1)).alias("n"), F.count("worker_id").alias("held"))


def queue_submit(spark, sf):
    """Failed jobs submitted again: the upsert resets them."""
    jobs = _jobs(spark, sf)
    again = jobs.where("state = 'failed'").withColumn("submitted_at", F.lit(NOW))
    out = O.submit(jobs, again)
    return out.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("completed_at").alias("completed"), F.max("submitted_at").alias("last"))


def queue_finish(spark, sf):
    """Running jobs ended by their execution records' outcomes."""
    jobs = _jobs(spark, sf).withColumn("run", uuid_hex(F.col("run_id")))
    records = table(spark, sf, "execution_records").select(uuid_hex(F.col("run_id")).alias("run"), F.lower(F.trim("outcome")).alias("outcome"), "completed_at", "loaded_at")
    last = O.last_by(records, ["run"], ["loaded_at"])
    ends = jobs.join(last.select("run", "outcome", F.col("completed_at").alias("ended_at")), "run").where("ended_at is not null").select("job_id", F.when(F.col("outcome") == "succeeded", "succeeded").otherwise("failed").alias("end_state"), F.lit(None).cast("string").alias("end_error"), "ended_at")
    return O.finish(jobs.drop("run"), ends).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count("completed_at").alias("completed"))


def worker_heartbeats(spark, sf):
    return table(spark, sf, "worker_leases").groupBy("worker_id").agg(F.max("loaded_at").alias("last_seen"), F.count(F.lit(1)).alias("beats"))


def lease_acquire(spark, sf):
    leases = O.last_by(table(spark, sf, "worker_leases").select(uuid_hex(F.col("job_id")).alias("job_id"), "worker_id", "expires_at", "loaded_at"), ["job_id"], ["loaded_at"])
    wanted = _jobs(spark, sf).where("state = 'running'").select("job_id", F.lit("w-new").alias("worker_id"), F.lit(NOW).alias("expires_at"))
    return O.acquire(leases, wanted, F.lit(NOW)).groupBy("granted", "worker_id").agg(F.count(F.lit(1)).alias("n"))


def lease_listing(spark, sf):
    """The 50 leases that end first."""
    leases = table(spark, sf, "worker_leases").select(uuid_text(uuid_hex(F.col("job_id"))).alias("job_id"), "worker_id", "expires_at").distinct()
    return O.listing(leases, "leases", 50)


def run_listing(spark, sf):
    runs = O.last_by(table(spark, sf, "control_runs").withColumn("run_id", uuid_text(uuid_hex(F.col("run_id")))), ["run_id"], ["loaded_at"])
    return O.listing(runs, "runs", 50).select("run_id", "pipeline_name", "created_at")


def dead_letter_listing(spark, sf):
    """Failed executions, newest first."""
    rows = table(spark, sf, "execution_records").withColumn("run_id", uuid_text(uuid_hex(F.col("run_id")))).where(F.lower(F.trim("outcome")) == "failed").where("created_at is not null")
    return O.listing(rows.select("run_id", "created_at").distinct(), "dead_letters", 50)


def pipeline_versions(spark, sf):
    return O.next_versions(table(spark, sf, "control_runs"), "pipeline_name", "pipeline_version")


def fetch_pages(spark, sf):
    """The urls of scraped documents, fetched from the table of requests."""
    asked = table(spark, sf, "scraped_documents").select(fetch.complete_url(F.col("url")).alias("url")).where("url is not null")
    return fetch.fetch_from_table(asked, table(spark, sf, "scrape_requests")).groupBy("status_code").agg(F.count(F.lit(1)).alias("n"), F.sum("content_length").alias("bytes"))


def run_outcomes(spark, sf):
    jobs = _jobs(spark, sf).withColumn("run", uuid_hex(F.col("run_id"))).where("run is not null")
    return O.outcomes(jobs, "run")


def checkpoint_latest(spark, sf):
    """The last step of every run by submission, then step."""
    jobs = table(spark, sf, "worker_jobs").where("run_id is not null and submitted_at is not null and step_id is not null").select(uuid_hex(F.col("run_id")).alias("run_id"), "submitted_at", "step_id")
    return O.last_by(jobs, ["run_id"], ["submitted_at", "step_id"])


def metadata_latest(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("namespace"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("payload"), "ts", "event_id")
    return O.last_by(rows, ["namespace", "key"], ["ts", "event_id"]).select("namespace", "key", "payload", "event_id").orderBy("namespace", "key")


def rate_limit(spark, sf):
    return O.rate_limit(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "event_id", rate=0.0005, burst=2).withColumn("wait_seconds", F.round("wait_seconds", 3))


def schedules(spark, sf) -> DataFrame:
    """Orders read as schedules, one of six kinds of trigger each."""
    o = table(spark, sf, "orders")
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    kind = F.element_at(F.array(*[F.lit(k) for k in O.TRIGGERS]), (key % 6 + 1).cast("int"))
    day = lambda n: date + F.make_dt_interval(days=F.lit(n))
    return o.select(
        key.alias("schedule_id"), F.col("o_orderpriority").alias("name"), kind.alias("kind"), F.when(key % 7 != 0, (F.col("o_custkey") % 10 + 1) * 3600).cast("long").alias("every_seconds"),
        F.when(key % 2 == 0, "*/15 * * * *").otherwise("30 */20 * * * *").alias("expression"), (key % 4 == 0).alias("catch_up"), date.alias("due_at"), F.lit(None).cast("timestamp").alias("next_run_at"),
        F.when(key % 3 == 0, day(1)).alias("last_run_at"), F.when(key % 5 == 0, day(400)).alias("expires_at"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("paused").alias("state"),
    )


THEN = datetime(1997, 1, 1, tzinfo=timezone.utc)


def schedule_due(spark, sf):
    return O.due(schedules(spark, sf), F.lit(THEN)).orderBy("effective_due_at", "name", "schedule_id").select("schedule_id", "name", "effective_due_at")


def schedule_next_run(spark, sf):
    return O.next_run(schedules(spark, sf), F.lit(THEN)).select("schedule_id", "kind", "next_run")


def schedule_mark_run(spark, sf):
    return O.mark_run(schedules(spark, sf), F.lit(THEN)).groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"), F.max("next_run_at").alias("latest"))


def schedule_dispatch(spark, sf):
    return O.dispatch(schedules(spark, sf), F.lit(THEN)).select("schedule_id", "kind", "name", "state", "submitted_at")


_HEX = "lower(regexp_replace(regexp_replace({0}, '[\\s{{}}-]', '', 'g'), '^urn:uuid:', '', 'i'))"
# the same for columns that hold values which are no keys: those are only trimmed and lower-cased
_KEY = f"case when regexp_full_match({_HEX}, '[0-9a-f]{{{{32}}}}') then {_HEX} else lower(regexp_replace({{0}}, '^\\s+|\\s+$', '', 'g')) end"
_JOBS = f"""with jobs as (select {_HEX.format('job_id')} as k, arg_max({{'c': lower(trim(execution_class)), 's': state, 'w': worker_id, 'sub': submitted_at, 'done': completed_at, 'l': lease_expires_at, 'r': {_KEY.format('run_id')}}}, loaded_at) as j from worker_jobs group by 1),
j as (select k, case when regexp_full_match(j.c, '[a-z0-9_-]+') then j.c end as c, j.s as s, j.w as w, j.sub as sub, j.done as done, j.l as l, j.r as r from jobs)"""
_S = """with s as (select o_orderkey as schedule_id, o_orderpriority as name, (['once','delay','interval','cron','dependency','backfill'])[o_orderkey % 6 + 1] as kind,
  case when o_orderkey % 7 <> 0 then (o_custkey % 10 + 1) * 3600 end as every, o_orderkey % 2 = 0 as quarter, o_orderkey % 4 = 0 as catch_up, o_orderdate::timestamptz as due_at,
  case when o_orderkey % 3 = 0 then o_orderdate::timestamptz + interval 1 day end as last_run_at, case when o_orderkey % 5 = 0 then o_orderdate::timestamptz + interval 400 day end as expires_at,
  case o_orderstatus when 'F' then 'done' when 'O' then 'scheduled' else 'paused' end as state from orders)"""
_THEN = "timestamptz '1997-01-01 00:00:00+00'"


def _next_sql(last: str, source: str) -> str:
    return f"""n as (select *, coalesce({last}, {_THEN}) as after, date_trunc('second', coalesce({last}, {_THEN})) as t from {source}),
    x as (select *, case when state in ('done', 'expired') or expires_at <= {_THEN} then null
      when kind in ('delay', 'interval') then case when every is null or {last} is null then due_at else {last} + to_seconds(every) end
      when kind = 'cron' then case when quarter then time_bucket(interval 15 minute, t) + interval 15 minute
        when t < time_bucket(interval 20 minute, t) + interval 30 second then time_bucket(interval 20 minute, t) + interval 30 second else time_bucket(interval 20 minute, t) + interval '20 minutes 30 seconds' end
      when kind in ('dependency', 'backfill') and catch_up and {last} is not null and every is not null then {last} + to_seconds(every)
      when {last} is null then due_at end as next_run from n)"""


QUERIES = {
    f.__name__: f
    for f in (
        scrape_pages, crawl_bfs, monitor_changes, archive_segments, archive_headers, provenance_envelopes, lineage_ancestors, condition_filter, queue_claim, queue_requeue, queue_submit, queue_finish, worker_heartbeats,
        lease_acquire, lease_listing, run_listing, dead_letter_listing, pipeline_versions, fetch_pages, run_outcomes, checkpoint_latest, metadata_latest, rate_limit, schedule_due, schedule_next_run, schedule_mark_run, schedule_dispatch,
    )
}
_PAGES = "p as (select page_id, arg_max({'u': url, 'h': html}, loaded_at) as r from scrape_requests where page_id is not null group by 1)"
# a string as JSON text with everything outside printable ASCII escaped
_ASCII = r"""'"' || array_to_string(list_transform(string_split(text, ''), lambda c: case when c = '"' then '\"' when c = '\' then '\\' when c = chr(10) then '\n' when c = chr(13) then '\r' when c = chr(9) then '\t'
  when c = chr(8) then '\b' when c = chr(12) then '\f' when unicode(c) between 32 and 126 then c when unicode(c) < 65536 then '\u' || lpad(lower(to_base(unicode(c), 16)), 4, '0')
  else '\u' || lower(to_base(55296 + ((unicode(c) - 65536) // 1024), 16)) || '\u' || lower(to_base(56320 + ((unicode(c) - 65536) % 1024), 16)) end), '') || '"'"""
_BUCKETS = """with recursive e as (select user_id, event_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as r from events),
s as (
  select user_id, event_id, r, t, t as last, 1.0::double as tokens from e where r = 1
  union all
  select user_id, event_id, r, t, come + case when have < 1 then (1 - have) / 0.0005 else 0 end, case when have < 1 then 0 else have - 1 end
  from (select e.user_id, e.event_id, e.r, e.t, greatest(e.t, s.last) as come, least(2.0, s.tokens + (greatest(e.t, s.last) - s.last) * 0.0005) as have from s join e on e.user_id = s.user_id and e.r = s.r + 1))
select user_id, event_id, round(last - t, 3) as wait_seconds, last - t <= 0 as admitted from s"""
SQL = {
    "archive_headers": f"""with {_PAGES}, h as (select page_id, r.u as u, r.h as h from p where r.h is not null and r.u is not null)
  select page_id, 'WARC-Payload-Digest' as name, 'sha256:' || sha256(h) as value from h union all select page_id, 'WARC-Refers-To', '<urn:uuid:' || sha256(u) || '>' from h
  union all select page_id, 'WARC-X-Meta-seedurl', substr(regexp_replace(u, '[\\r\\n]', ' ', 'g'), 1, 4096) from h union all select page_id, 'WARC-X-Meta-payload-header-Content-Type', 'text/html' from h""",
    "provenance_envelopes": f"""with f as (select doc_id, text, sha256('{{"metadata": {{"lang": ' || coalesce('"' || lang || '"', 'null') || '}}, "payload": {{"document_id": ' || doc_id || ', "text": ' || {_ASCII} || '}}, "resource_type": "document", "schema_version": "1.0"}}') as fp from documents where text is not null)
  select doc_id as document_id, 'document' as resource_type, '1.0' as schema_version, fp as fingerprint, sha256(fp || '||' || doc_id || '|' || text) as resource_id from f""",
    "rate_limit": _BUCKETS,
    "monitor_changes": """with d as (select event_id, user_id, sha256(event_type) as h, lag(sha256(event_type)) over (partition by user_id order by ts, event_id) as p from events)
      select event_id, user_id, h as body_sha256, p as previous_sha256, p is null or p <> h as changed from d""",
    "lineage_ancestors": """with v as (select distinct 'record/' || record_id as r, 'page/' || document_id as p, 'shelf/' || length(document_id) as s from vector_records where document_id is not null and record_id is not null)
      select r as child, p as ancestor, 1 as distance from v union select p, s, 1 from v union select r, s, 2 from v""",
    "condition_filter": "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem where 1 < l_quantity and l_quantity <= 24 and (l_returnflag = 'R' or not coalesce(l_discount < 0.05, false))",
    "queue_claim": f"""{_JOBS}, r as (select *, row_number() over (partition by c order by sub nulls first, k) as slot from j where s = 'queued')
      select c as execution_class, cast(slot as int) as slot, concat_ws('-', substr(k, 1, 8), substr(k, 9, 4), substr(k, 13, 4), substr(k, 17, 4), substr(k, 21, 12)) as job_id, 'running' as state, {NOW_SQL} as claimed_at, {NOW_SQL} + interval 60 second as lease_expires_at from r where slot <= 5""",
    "queue_requeue": f"""{_JOBS}, x as (select *, coalesce(s = 'running' and l <= {NOW_SQL}, false) as q from j)
      select c as execution_class, case when q then 'queued' else s end as state, q as requeued, count(*) as n, count(w) filter (not q) as held from x group by 1, 2, 3""",
    "queue_submit": f"""{_JOBS}, x as (select case when s = 'failed' then 'queued' else s end as state, case when s <> 'failed' then done end as done, case when s = 'failed' then {NOW_SQL} else sub end as sub from j)
      select state, count(*) as n, count(done) as completed, max(sub) as last from x group by 1""",
    "queue_finish": f"""{_JOBS}, e as (select {_HEX.format('run_id')} as r, arg_max({{'o': lower(trim(outcome)), 'c': completed_at}}, loaded_at) as e from execution_records group by 1),
      x as (select j.*, e.e.o as o, e.e.c as ended from j left join e on j.r = e.r),
      y as (select case when s = 'running' and ended is not null then case when o = 'succeeded' then 'succeeded' else 'failed' end else s end as state, case when s = 'running' and ended is not null then ended else done end as done from x)
      select state, count(*) as n, count(done) as completed from y group by 1""",
    "worker_heartbeats": "select worker_id, max(loaded_at) as last_seen, count(*) as beats from worker_leases group by 1",
    "lease_acquire": f"""{_JOBS}, l as (select {_HEX.format('job_id')} as k, arg_max({{'w': worker_id, 'e': expires_at}}, loaded_at) as l from worker_leases group by 1),
      x as (select coalesce(j.k is not null and (l.l.w is null or l.l.e <= {NOW_SQL} or l.l.w = 'w-new'), false) as granted, l.l.w as old from l full join (select k from j where s = 'running') j on l.k = j.k)
      select granted, case when granted then 'w-new' else old end as worker_id, count(*) as n from x group by 1, 2""",
    "lease_listing": f"""select concat_ws('-', substr(k, 1, 8), substr(k, 9, 4), substr(k, 13, 4), substr(k, 17, 4), substr(k, 21, 12)) as job_id, worker_id, expires_at from (select distinct {_HEX.format('job_id')} as k, worker_id, expires_at from worker_leases) order by expires_at nulls first, k limit 50""",
    "run_listing": f"""with r as (select {_HEX.format('run_id')} as k, arg_max({{'p': pipeline_name, 'c': created_at}}, loaded_at) as r from control_runs group by 1)
      select concat_ws('-', substr(k, 1, 8), substr(k, 9, 4), substr(k, 13, 4), substr(k, 17, 4), substr(k, 21, 12)) as run_id, r.p as pipeline_name, r.c as created_at from r order by r.c nulls first, k limit 50""",
    "dead_letter_listing": f"""select concat_ws('-', substr(k, 1, 8), substr(k, 9, 4), substr(k, 13, 4), substr(k, 17, 4), substr(k, 21, 12)) as run_id, created_at from
      (select distinct {_HEX.format('run_id')} as k, created_at from execution_records where lower(trim(outcome)) = 'failed' and created_at is not null) order by created_at desc, k limit 50""",
    "pipeline_versions": "select pipeline_name, coalesce(max(pipeline_version), 0) + 1 as next_version from control_runs where pipeline_name is not null group by 1",
    "fetch_pages": """with a as (select distinct case when regexp_full_match(url, '[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') then url || '/' else url end as url from scraped_documents where url is not null),
      p as (select url, max(html) as html from scrape_requests where url is not null group by 1)
      select case when html is null then 404 else 200 end as status_code, count(*) as n, cast(sum(strlen(html)) as bigint) as bytes from a left join p on a.url = p.url group by 1""",
    "run_outcomes": f"""{_JOBS} select r as run, case when coalesce(bool_or(s = 'failed'), false) and coalesce(bool_or(s = 'succeeded'), false) then 'partially_succeeded' when coalesce(bool_or(s = 'failed'), false) then 'failed'
      when coalesce(bool_or(s = 'cancelled'), false) then 'cancelled' else 'succeeded' end as outcome, count(*) as steps from j where r is not null group by 1""",
    "checkpoint_latest": f"""select run_id, submitted_at, step_id from (select {_KEY.format('run_id')} as run_id, submitted_at, step_id, row_number() over (partition by {_KEY.format('run_id')} order by submitted_at desc, step_id desc) as r
      from worker_jobs where run_id is not null and submitted_at is not null and step_id is not null) where r = 1""",
    "metadata_latest": """select namespace, key, payload, event_id from (select event_type as namespace, cast(user_id as varchar) as key, props as payload, event_id,
      row_number() over (partition by event_type, user_id order by ts desc, event_id desc) as r from events) where r = 1""",
    "schedule_due": f"{_S} select schedule_id, name, due_at as effective_due_at from s where state = 'scheduled' and (expires_at is null or expires_at > {_THEN}) and due_at <= {_THEN}",
    "schedule_next_run": f"{_S}, {_next_sql('last_run_at', 's')} select schedule_id, kind, next_run from x",
    "schedule_mark_run": f"{_S}, {_next_sql('ran', f'(select *, {_THEN} as ran from s)')} select kind, case when next_run is null then 'done' else 'scheduled' end as state, count(*) as n, max(next_run) as latest from x group by 1, 2",
    "schedule_dispatch": f"{_S} select schedule_id, 'schedule' as kind, name, 'queued' as state, {_THEN} as submitted_at from s where state = 'scheduled' and (expires_at is null or expires_at > {_THEN}) and due_at <= {_THEN}",
}
